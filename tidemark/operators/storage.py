"""Table maintenance: upserts, insert-ignore, counters, purges, cascades.

Each operator returns the new state of a table; write it to a new location or partition and swap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timing import at
from tidemark.operators import ordered

KEPT_FROM_FIRST = ("crawled_at", "is_indexed", "language")  # fixed values


def page_upsert(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per URL. The newest version wins; a few fields stay as first seen. One aggregate with
    partial results, so a URL that is crawled very often folds before the shuffle."""
    both = current.withColumn("_age", F.lit(0)).unionByName(incoming.withColumn("_age", F.lit(1)))
    fields = [c for c in current.columns if c != "url"]
    kept = [c for c in fields if c in KEPT_FROM_FIRST]
    moving = [c for c in fields if c not in kept]
    order = F.struct("_age", "updated_at", F.xxhash64(*fields))  # a fixed one of versions at one instant
    folded = both.groupBy("url").agg(F.max_by(F.struct(*moving), order).alias("_new"), F.min_by(F.struct(*kept), order).alias("_first"))
    return folded.select("url", "_new.*", "_first.*").select(*current.columns)


def link_insert_ignore(existing: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Links plus the new ones; of a repeated (source, target) the first is kept."""
    keys = ["source_page_id", "target_url"]
    fresh = ordered.first_per_key(incoming, keys, [F.col(order)]).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh)


def counter_upsert(current: DataFrame, deltas: DataFrame, key: str = "stat_date") -> DataFrame:
    """Counters added into their day's row."""
    counters = [c for c in current.columns if c != key]
    return current.unionByName(deltas).groupBy(key).agg(*[F.sum(c).alias(c) for c in counters])


def unindexed_batch(pages: DataFrame, indexed: DataFrame, n: int) -> DataFrame:
    """Oldest pages that are not in the index."""
    return pages.join(indexed.select("page_id"), "page_id", "left_anti").orderBy("crawled_at", "page_id").limit(n)


def mark_indexed(pages: DataFrame, batch: DataFrame) -> DataFrame:
    """Flag of the pages of a batch set."""
    done = batch.select("page_id").withColumn("_done", F.lit(True))
    return pages.join(done, "page_id", "left").withColumn("is_indexed", F.col("is_indexed") | F.coalesce("_done", F.lit(False))).drop("_done")


def ttl_purge(df: DataFrame, as_of: str, column: str = "expires_at") -> DataFrame:
    """What has not expired (rows without expiry stay)."""
    return df.where(F.col(column).isNull() | (F.col(column) >= at(as_of)))


def cascade_delete(campaign_ids: DataFrame, campaigns: DataFrame, ad_groups: DataFrame, ads: DataFrame,
                   dependants: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Every table without the given campaigns and all that hangs below them. ``dependants`` maps a
    name to (table, key) where the key is ad_id, or click_id for rows below a click."""
    gone_groups = ad_groups.join(campaign_ids, "campaign_id", "left_semi").select("ad_group_id")
    gone_ads = ads.join(gone_groups, "ad_group_id", "left_semi").select("ad_id")
    out = {
        "campaigns": campaigns.join(campaign_ids, "campaign_id", "left_anti"),
        "ad_groups": ad_groups.join(campaign_ids, "campaign_id", "left_anti"),
        "ads": ads.join(gone_groups, "ad_group_id", "left_anti"),
    }
    for name, (table, key) in dependants.items():
        if key == "click_id":
            gone = dependants["clicks"][0].join(gone_ads, "ad_id", "left_semi").select("click_id")
        else:
            gone = gone_ads
        out[name] = table.join(gone, key, "left_anti")
    return out


def crawl_stats_summary(pages: DataFrame) -> DataFrame:
    """S12."""
    return pages.agg(F.count(F.lit(1)).alias("total_pages"), F.count_if("is_indexed").alias("pages_indexed"),
                     F.avg("load_time_ms").alias("avg_load_time"))
