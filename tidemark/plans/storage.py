"""Storage queries: S5-S8, S10-S13."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import r6
from tidemark.operators import pages as pg
from tidemark.operators import storage
from tidemark.plans.registry import cte, query
from tidemark.sources import tables
from tidemark.sources.testbed import AS_OF

cte("stored_pages", """
SELECT page_id, url, length(html) AS size, page_id % 2 = 0 AS is_indexed, 'en' AS language, TIMESTAMP '2024-01-01' + to_hours(page_id * 7 % 500) AS crawled_at,
  TIMESTAMP '2024-01-01' + to_hours(page_id) AS updated_at, page_id * 13 % 900 AS load_time_ms FROM pages""")


def stored(t):
    k = F.col("page_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return t.table("pages").select(
        "page_id", "url", F.length("html").cast("bigint").alias("size"), (k % 2 == 0).alias("is_indexed"), F.lit("en").alias("language"),
        F.timestamp_add("HOUR", k * 7 % 500, start).alias("crawled_at"), F.timestamp_add("HOUR", k, start).alias("updated_at"),
        (k * 13 % 900).alias("load_time_ms"))


@query("page_upsert", """
SELECT url, CASE WHEN page_id % 3 = 0 THEN size + 2 ELSE size END AS size, is_indexed, language, crawled_at,
  CASE WHEN page_id % 3 = 0 THEN updated_at + INTERVAL 1002 HOUR ELSE updated_at END AS updated_at FROM stored_pages
UNION ALL SELECT url || '?new', size + 2, false, 'xx', crawled_at + INTERVAL 1001 HOUR, updated_at + INTERVAL 1002 HOUR FROM stored_pages WHERE page_id % 5 = 0""")
def _(t):
    s = stored(t)
    rounds = F.explode(F.array(F.lit(1), F.lit(2))).alias("i")
    again = s.where(F.col("page_id") % 3 == 0).select("*", rounds)
    fresh = s.where(F.col("page_id") % 5 == 0).select("*", rounds).withColumn("url", F.concat("url", F.lit("?new")))
    incoming = again.unionByName(fresh).withColumns({
        "size": F.col("size") + F.col("i"), "is_indexed": F.lit(False), "language": F.lit("xx"),
        "crawled_at": F.timestamp_add("HOUR", F.lit(1000) + F.col("i"), F.col("crawled_at")),
        "updated_at": F.timestamp_add("HOUR", F.lit(1000) + F.col("i"), F.col("updated_at"))}).drop("i")
    return storage.page_upsert(s, incoming).select("url", "size", "is_indexed", "language", "crawled_at", "updated_at")


@query("link_insert_ignore", """
SELECT source_page_id, target_url, min(anchor_text) AS anchor_text FROM page_links GROUP BY ALL""")
def _(t):
    links = pg.extract_links(t.table("pages")).select("source_page_id", "target_url", "anchor_text")
    first = links.where(F.col("source_page_id") % 2 == 0).groupBy("source_page_id", "target_url").agg(F.min("anchor_text").alias("anchor_text"))
    return storage.link_insert_ignore(first, links, "anchor_text")


@query("daily_counter_upsert", """
SELECT stat_date, CAST(sum(pages) AS BIGINT) AS pages_crawled, CAST(sum(bytes) AS BIGINT) AS links_extracted FROM (
  SELECT CAST(crawled_at AS DATE) AS stat_date, 1 AS pages, size AS bytes FROM stored_pages
  UNION ALL SELECT CAST(updated_at AS DATE), 2, 5 FROM stored_pages) GROUP BY ALL""")
def _(t):
    s = stored(t)
    current = s.groupBy(F.col("crawled_at").cast("date").alias("stat_date")).agg(F.count(F.lit(1)).alias("pages_crawled"), F.sum("size").alias("links_extracted"))
    deltas = s.select(F.col("updated_at").cast("date").alias("stat_date"), F.lit(2).cast("bigint").alias("pages_crawled"), F.lit(5).cast("bigint").alias("links_extracted"))
    return storage.counter_upsert(current, deltas)


@query("unindexed_batch", "SELECT page_id, crawled_at FROM stored_pages WHERE NOT is_indexed ORDER BY crawled_at, page_id LIMIT 30")
def _(t):
    s = stored(t)
    return storage.unindexed_batch(s, s.where("is_indexed"), 30).select("page_id", "crawled_at")


@query("mark_indexed", """
SELECT page_id, is_indexed OR page_id IN (SELECT page_id FROM stored_pages WHERE NOT is_indexed ORDER BY crawled_at, page_id LIMIT 30) AS is_indexed FROM stored_pages""")
def _(t):
    s = stored(t)
    return storage.mark_indexed(s, storage.unindexed_batch(s, s.where("is_indexed"), 30)).select("page_id", "is_indexed")


@query("ttl_purge", f"SELECT ad_id, date, impression_count FROM ad_metrics WHERE expires_at >= TIMESTAMP '{AS_OF}'")
def _(t):
    return storage.ttl_purge(t.ad_metrics(), AS_OF).select("ad_id", "date", "impression_count")


cte("gone_ads", "SELECT ad_id FROM ads JOIN ad_groups USING (ad_group_id) WHERE campaign_id IN (1, 4)")


@query("cascade_delete", """
SELECT 'campaigns' AS name, (SELECT count(*) FROM campaigns WHERE campaign_id NOT IN (1, 4)) AS rows_left
UNION ALL SELECT 'ad_groups', (SELECT count(*) FROM ad_groups WHERE campaign_id NOT IN (1, 4))
UNION ALL SELECT 'ads', (SELECT count(*) FROM ads WHERE ad_id NOT IN (SELECT ad_id FROM gone_ads))
UNION ALL SELECT 'metrics', (SELECT count(*) FROM ad_metrics WHERE ad_id NOT IN (SELECT ad_id FROM gone_ads))
UNION ALL SELECT 'clicks', (SELECT count(*) FROM clicks WHERE ad_id NOT IN (SELECT ad_id FROM gone_ads))
UNION ALL SELECT 'conversions', (SELECT count(*) FROM conversions v JOIN clicks c USING (click_id) WHERE c.ad_id NOT IN (SELECT ad_id FROM gone_ads))""")
def _(t):
    gone = t.campaigns().where(F.col("campaign_id").isin(1, 4)).select("campaign_id")
    left = storage.cascade_delete(gone, t.campaigns(), t.ad_groups(), t.ads(), {
        "metrics": (t.ad_metrics(), "ad_id"), "clicks": (t.clicks(), "ad_id"), "conversions": (t.conversions(), "click_id")})
    out = None
    for name, df in left.items():
        one = df.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(name).alias("name"), "rows_left")
        out = one if out is None else out.unionByName(one)
    return out


@query("crawl_stats_summary", """
SELECT count(*) AS total_pages, count(*) FILTER (is_indexed) AS pages_indexed, round(avg(load_time_ms), 6) AS avg_load_time FROM stored_pages""")
def _(t):
    return storage.crawl_stats_summary(stored(t)).withColumn("avg_load_time", r6(F.col("avg_load_time")))


@query("reference_check", """
SELECT click_id, ad_id, ad_id IN (SELECT ad_id FROM ads WHERE ad_id % 3 <> 0) AS accepted FROM clicks""")
def _(t):
    ads = t.ads().where(F.col("ad_id") % 3 != 0)
    ok = tables.accepted(t.clicks(), ads, "ad_id", "ad_id").select("click_id", "ad_id", F.lit(True).alias("accepted"))
    return ok.unionByName(tables.rejected(t.clicks(), ads, "ad_id", "ad_id").select("click_id", "ad_id", F.lit(False).alias("accepted")))
