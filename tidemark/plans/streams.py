"""Streaming queries: S3, S4, ST1-ST7. Each runs over the given table as a file stream until it is read,
and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import r6
from tidemark.operators import experiments as ex
from tidemark.plans.experiments import tests, users, variants
from tidemark.plans.registry import cte, query
from tidemark.plans.topics import KEYWORDS  # noqa: F401  (defines query_words)
from tidemark.session import shared_folder
from tidemark.sources import testbed as tb
from tidemark.sources.testbed import AS_OF, Testbed
from tidemark.streaming import jobs, visited


class StreamBed(Testbed):
    """The same adapters over file streams."""

    def table(self, name):
        return jobs.file_stream(self.spark, self.directory, name)


def appended(t, df, name, fmt="parquet"):
    folder = shared_folder(t.spark, name)
    jobs.append_to(df, f"{folder}/out", f"{folder}/state", fmt).awaitTermination()
    return folder + "/out"


def replaced(t, df, name):
    folder = shared_folder(t.spark, name)
    jobs.replace_at(df, f"{folder}/out", f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(folder + "/out")


def streaming(t):
    return StreamBed(t.spark, t.directory)


# windows are final once the watermark, ten minutes behind the newest event, has passed them
@query("live_metrics_stream", """
SELECT window_start, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks,
  count(*) FILTER (event_type = 'purchase') AS conversions,
  round(CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN count(*) FILTER (event_type = 'click') / count(*) FILTER (event_type = 'view') * 100 ELSE 0 END, 2) AS ctr
FROM (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(i) AS window_start, ts FROM events, (SELECT unnest([0, 1]) AS i))
WHERE ts < window_start + INTERVAL 2 HOUR AND window_start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY window_start""")
def _(t):
    e = jobs.as_event_time(streaming(t).table("events"))
    return t.spark.read.parquet(appended(t, jobs.live_metrics_stream(e, "2 hours", "1 hour"), "live"))


@query("velocity_stream", """
SELECT ip_hash, window_start, count(*) AS clicks FROM (
  SELECT ip_hash, time_bucket(INTERVAL 3 HOUR, ts) - to_hours(3 * i) AS window_start FROM clicks, (SELECT unnest([0, 1]) AS i))
WHERE window_start + INTERVAL 6 HOUR <= (SELECT max(ts) FROM clicks) - INTERVAL 10 MINUTE GROUP BY ALL HAVING count(*) >= 5""")
def _(t):
    c = jobs.as_event_time(streaming(t).clicks())
    return t.spark.read.parquet(appended(t, jobs.velocity_stream(c, 5, "6 hours", "3 hours"), "velocity"))


@query("sanitised_click_stream", "SELECT click_id, ad_id, substr(sha256(session_id), 1, 16) AS session_id, ip_hash FROM clicks")
def _(t):
    out = t.spark.read.parquet(appended(t, jobs.sanitised_click_stream(streaming(t).clicks()), "clean"))
    return out.select("click_id", "ad_id", "session_id", "ip_hash")


@query("variant_counter_stream", """
SELECT variant_id, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(conversions) AS BIGINT) AS conversions,
  round(sum(revenue), 6) AS revenue FROM ab_rollup GROUP BY variant_id""")
def _(t):
    placed = ex.assign(users(t), tests(t), variants(t)).where(F.col("variant_id").isNotNull()).select("test_id", "user_id", "variant_id")
    k = F.get_json_object("props", "$.k").cast("bigint")
    e = streaming(t).table("events").where(F.col("event_type").isin("view", "click", "purchase")).select(
        (k % 5).alias("test_id"), "user_id", "event_type", "value").join(placed, ["test_id", "user_id"])
    return replaced(t, jobs.variant_counters(e), "variants").withColumn("revenue", r6(F.col("revenue")))


@query("incremental_index_stream", "SELECT term, page_id, field, tf FROM postings")
def _(t):
    folder = shared_folder(t.spark, "index")
    jobs.each_batch(streaming(t).table("pages"), jobs.index_batch(f"{folder}/postings"), f"{folder}/state").awaitTermination()
    return t.spark.read.parquet(f"{folder}/postings").select("term", "page_id", "field", "tf")


@query("trending_stream", f"""
SELECT keyword, round(sum(n * greatest(0.1::DOUBLE, 1 - age / 24)), 6) AS score FROM (
  SELECT keyword, count(*) AS n, date_diff('second', date_trunc('hour', ts), TIMESTAMP '{AS_OF}') / 3600.0::DOUBLE AS age
  FROM (SELECT ts, unnest(keywords) AS keyword FROM query_words) GROUP BY keyword, date_trunc('hour', ts))
WHERE age <= 24 GROUP BY keyword ORDER BY score DESC, keyword LIMIT 50""")
def _(t):
    q = jobs.as_event_time(streaming(t).queries())
    return jobs.decayed(replaced(t, jobs.hourly_keywords(q), "trending"), AS_OF)


@query("visited_dedup_stream", "SELECT DISTINCT 'http://ads.example/' || ad_id AS url FROM keyed_events")
def _(t):
    k = F.get_json_object("props", "$.k")
    e = streaming(t).table("events").select(F.concat(F.lit("http://ads.example/"), k).alias("url"), "ts")
    out = appended(t, jobs.visited_dedup(jobs.as_event_time(e, late="24 hours")), "visited")
    return t.spark.read.parquet(out).select("url")


# spans follow each other: the first visit at or after the end of the last span opens the next one
@query("visited_ttl_stream", """
WITH RECURSIVE visits AS (SELECT 'http://ads.example/' || ad_id AS url, ts FROM keyed_events WHERE ad_id IS NOT NULL AND ts IS NOT NULL),
opened AS (
  SELECT url, min(ts) AS ts FROM visits GROUP BY url
  UNION ALL
  SELECT o.url, min(v.ts) FROM opened o JOIN visits v ON v.url = o.url AND v.ts >= o.ts + INTERVAL 24 HOUR GROUP BY o.url)
SELECT url, ts FROM opened""")
def _(t):
    k = F.get_json_object("props", "$.k")
    e = streaming(t).table("events").select(F.concat(F.lit("http://ads.example/"), k).alias("url"), "ts")
    with visited.state_store(t.spark):
        out = appended(t, visited.visited_dedup(jobs.as_event_time(e, late="24 hours")), "visited-ttl")
    return t.spark.read.parquet(out).select("url", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("event_stream_sink", """
SELECT count(*) AS envelopes, count(DISTINCT event_id) AS events FROM events""")
def _(t):
    lines = t.spark.read.text(appended(t, jobs.write_events(streaming(t).table("events"), "clicks.recorded", F.col("ts")), "sink", "text"))
    return lines.agg(F.count(F.lit(1)).alias("envelopes"),
                     F.count_distinct(F.get_json_object("value", "$.data.event_id")).alias("events"))


@query("event_stream_source", """
SELECT event_id, user_id, event_type AS kind, value, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS sent_at, 'clicks.recorded' AS event_type FROM events""")
def _(t):
    sink = appended(t, jobs.write_events(
        streaming(t).table("events").withColumnRenamed("event_type", "kind"), "clicks.recorded", F.col("ts")), "sink", "text")
    raw = t.spark.readStream.schema("value STRING").text(sink)
    back = jobs.read_events(raw, "event_id: BIGINT, user_id: BIGINT, kind: STRING, value: DOUBLE")
    out = t.spark.read.parquet(appended(t, back, "source"))
    return out.select("event_id", "user_id", "kind", "value", F.col("timestamp").alias("sent_at"), "event_type")
