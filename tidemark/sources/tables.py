"""Table scans: the catalogue of fixed schemas, typed reads, filtered pages and reference checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_LIMIT = 1000  # fixed value: the largest page a listing returns unless told otherwise

# The tables of the platform, in Spark DDL.
CATALOGUE: dict[str, str] = {
    "advertisers": "id BIGINT, name STRING, contact_email STRING, created_at TIMESTAMP_NTZ",
    "campaigns": "id BIGINT, advertiser_id BIGINT, name STRING, start_date TIMESTAMP_NTZ, end_date TIMESTAMP_NTZ,"
                 " budget DOUBLE, daily_budget DOUBLE, status STRING",
    "ad_groups": "id BIGINT, campaign_id BIGINT, name STRING, targeting_settings STRING, bid_strategy STRING",
    "ads": "id BIGINT, advertiser_id BIGINT, ad_group_id BIGINT, title STRING, description STRING, url STRING,"
           " targeting_constraints STRING, ethical_tags STRING, quality_score DOUBLE, creative_format STRING,"
           " bid_amount DOUBLE, status STRING, approval_status STRING",
    "creative_assets": "id BIGINT, ad_id BIGINT, asset_type STRING, asset_url STRING, payload STRING,"
                       " checksum STRING",
    "ad_metrics": "id BIGINT, ad_id BIGINT, date DATE, intent_goal STRING, intent_use_case STRING,"
                  " impression_count BIGINT, click_count BIGINT, conversion_count BIGINT, ctr DOUBLE, cpm DOUBLE,"
                  " cpc DOUBLE, roas DOUBLE, engagement_rate DOUBLE, spend DOUBLE, revenue DOUBLE,"
                  " created_at TIMESTAMP_NTZ, expires_at TIMESTAMP_NTZ",
    "click_tracking": "id BIGINT, ad_id BIGINT, session_id STRING, timestamp TIMESTAMP_NTZ, ip_hash STRING,"
                      " user_agent_hash STRING, referring_url STRING, payload STRING",
    "conversion_tracking": "id BIGINT, click_id BIGINT, conversion_type STRING, value DOUBLE,"
                           " timestamp TIMESTAMP_NTZ, status STRING",
    "fraud_detection": "id BIGINT, event_id BIGINT, event_type STRING, reason STRING, severity STRING,"
                       " review_status STRING, ad_id BIGINT",
    "ab_tests": "id BIGINT, campaign_id BIGINT, name STRING, status STRING, traffic_allocation DOUBLE,"
                " min_sample_size BIGINT, confidence_level DOUBLE, primary_metric STRING",
    "ab_test_variants": "id BIGINT, test_id BIGINT, name STRING, traffic_weight DOUBLE, is_control BOOLEAN,"
                        " impressions BIGINT, clicks BIGINT, conversions BIGINT, revenue DOUBLE",
    "ab_test_assignments": "id BIGINT, test_id BIGINT, variant_id BIGINT, user_hash STRING",
    "user_consents": "id BIGINT, user_id STRING, consent_type STRING, granted BOOLEAN, granted_at TIMESTAMP_NTZ,"
                     " expires_at TIMESTAMP_NTZ, withdrawn_at TIMESTAMP_NTZ, created_at TIMESTAMP_NTZ",
    "audit_trails": "id BIGINT, user_id STRING, event_type STRING, resource_type STRING, resource_id BIGINT,"
                    " timestamp TIMESTAMP_NTZ, payload STRING",
    "crawled_pages": "id STRING, url STRING, final_url STRING, title STRING, content STRING, html STRING,"
                     " meta_description STRING, meta_keywords STRING, status_code INT, content_type STRING,"
                     " content_length BIGINT, load_time_ms BIGINT, crawl_depth INT, outbound_links INT,"
                     " inbound_links INT, pagerank DOUBLE, language STRING, is_indexed BOOLEAN,"
                     " crawled_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, next_crawl_at TIMESTAMP_NTZ",
    "page_links": "source_page_id STRING, target_url STRING, anchor_text STRING, link_type STRING,"
                  " created_at TIMESTAMP_NTZ",
    "crawl_queue": "id STRING, url STRING, priority INT, depth INT, status STRING, scheduled_at TIMESTAMP_NTZ",
    "crawl_stats": "stat_date DATE, pages_crawled BIGINT, pages_failed BIGINT, pages_indexed BIGINT,"
                   " links_extracted BIGINT",
    "query_history": "query STRING, keywords ARRAY<STRING>, timestamp TIMESTAMP_NTZ, category STRING",
}


def schema_of(name: str) -> T.StructType:
    return T._parse_datatype_string(CATALOGUE[name])


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Typed read of a catalogue table, or of any other Parquet table with its own schema."""
    path = f"{directory}/{name}.parquet"
    reader = spark.read.schema(CATALOGUE[name]) if name in CATALOGUE else spark.read
    return reader.parquet(path)


def load_jdbc(spark: SparkSession, url: str, name: str, split_column: str, low: int, high: int, parts: int,
              **options: str) -> DataFrame:
    """S1 over a live database, read in parallel ranges of a numeric key."""
    return (spark.read.format("jdbc").options(
        url=url, dbtable=name, partitionColumn=split_column, lowerBound=str(low), upperBound=str(high),
        numPartitions=str(parts), **options).load())


def list_rows(df: DataFrame, filters: Mapping[str, Any] | None = None, skip: int = 0, limit: int = 100,
              order: Sequence[str | Column] = ("id",), largest: int | None = PAGE_LIMIT) -> DataFrame:
    """Equality filters, then one page. Negative numbers count as 0; a page has at most ``largest`` rows (None: any)."""
    for column, value in (filters or {}).items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    rows = max(limit, 0) if largest is None else min(max(limit, 0), largest)
    return df.orderBy(*order).offset(max(skip, 0)).limit(rows)


def accepted(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent exists."""
    keys = parent.select(F.col(parent_key).alias(key))
    return child.join(keys, key, "left_semi")


def rejected(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is missing (a null key has no parent)."""
    keys = parent.select(F.col(parent_key).alias(key))
    return child.join(keys, key, "left_anti")
