"""Experiment queries: X1-X9, A13, WN7. A campaign is a test, its ad groups are the variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.text import r6
from tidemark.operators import experiments as ex
from tidemark.plans.registry import cte, query

HORNER = "0"
for i in range(4):
    HORNER = f"(({HORNER}) * {(1 << 32) % ex.BUCKETS} + CAST('0x' || substr(md5(user_hash), {8 * i + 1}, 8) AS BIGINT)) % {ex.BUCKETS}"

cte("ab_tests", """
SELECT CAST(r_regionkey AS BIGINT) AS test_id, CASE WHEN r_regionkey = 4 THEN 'draft' ELSE 'running' END AS status,
  CASE WHEN r_regionkey = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS traffic_allocation,
  CASE WHEN r_regionkey = 2 THEN 100000 ELSE 100 END::BIGINT AS min_sample_size,
  CASE WHEN r_regionkey = 0 THEN 0.9::DOUBLE WHEN r_regionkey = 3 THEN 0.5::DOUBLE ELSE 0.95::DOUBLE END AS confidence_level FROM region""")
cte("ab_variants", """
SELECT CAST(n_nationkey AS BIGINT) AS variant_id, CAST(n_regionkey AS BIGINT) AS test_id,
  CASE WHEN n_regionkey = 3 THEN 0.15::DOUBLE ELSE 0.2::DOUBLE END AS traffic_weight,
  n_nationkey < 10 AND n_nationkey >= 5 AS is_control FROM nation""")
cte("ab_users", "SELECT DISTINCT ad_id % 5 AS test_id, user_id FROM keyed_events")
cte("ab_hashed", "SELECT test_id, user_id, sha256(test_id || ':' || user_id) AS user_hash FROM ab_users")
cte("ab_buckets", f"SELECT *, {HORNER} AS bucket FROM ab_hashed")
cte("ab_ranges", """
SELECT test_id, variant_id, high - traffic_weight AS low, CASE WHEN last THEN greatest(high, 1.0) ELSE high END AS high FROM (
  SELECT *, sum(traffic_weight) OVER (PARTITION BY test_id ORDER BY variant_id) AS high,
    variant_id = max(variant_id) OVER (PARTITION BY test_id) AS last FROM ab_variants)""")
cte("ab_assigned", """
SELECT b.test_id, b.user_id, b.user_hash, b.bucket, CASE WHEN b.bucket % 100 < t.traffic_allocation * 100 THEN
  (SELECT min(r.variant_id) FROM ab_ranges r WHERE r.test_id = b.test_id AND b.bucket / 10000.0::DOUBLE < r.high) END AS variant_id
FROM ab_buckets b JOIN ab_tests t USING (test_id) WHERE t.status = 'running'""")
cte("ab_existing", """
SELECT test_id, user_hash, test_id + 20 AS variant_id FROM ab_hashed WHERE user_id % 6 = 0""")
cte("ab_rollup", """
SELECT a.test_id, a.variant_id, count(*) FILTER (event_type = 'view') AS impressions,
  count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS conversions,
  coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS revenue
FROM keyed_events e JOIN ab_assigned a ON a.test_id = e.ad_id % 5 AND a.user_id = e.user_id
WHERE a.variant_id IS NOT NULL AND e.event_type IN ('view', 'click', 'purchase') GROUP BY ALL""")
# variants with their counters; ab_variants without events count zero
cte("ab_counted", """
SELECT v.variant_id, v.test_id, v.is_control, coalesce(r.impressions, 0) AS impressions, coalesce(r.clicks, 0) AS clicks,
  coalesce(r.conversions, 0) AS conversions FROM ab_variants v LEFT JOIN ab_rollup r USING (test_id, variant_id)""")


def tests(t):
    key = F.col("r_regionkey").cast("bigint")
    return t.table("region").select(
        key.alias("test_id"), F.when(key == 4, "draft").otherwise("running").alias("status"),
        F.when(key == 1, 0.5).otherwise(1.0).alias("traffic_allocation"),
        F.when(key == 2, 100000).otherwise(100).cast("bigint").alias("min_sample_size"),
        F.when(key == 0, 0.9).when(key == 3, 0.5).otherwise(0.95).alias("confidence_level"))


def variants(t):
    key = F.col("n_nationkey").cast("bigint")
    return t.table("nation").select(
        key.alias("variant_id"), F.col("n_regionkey").cast("bigint").alias("test_id"),
        F.when(F.col("n_regionkey") == 3, 0.15).otherwise(0.2).alias("traffic_weight"),
        ((key < 10) & (key >= 5)).alias("is_control"))


def events(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return t.table("events").select((k % 5).alias("test_id"), "user_id", "event_type", "value")


def users(t):
    return events(t).select("test_id", "user_id").distinct()


def assigned(t):
    return ex.assign(users(t), tests(t), variants(t))


def counted(t):
    kind = (F.when(F.col("event_type") == "view", "impression").when(F.col("event_type") == "click", "click")
            .when(F.col("event_type") == "purchase", "conversion"))
    seen = events(t).withColumn("kind", kind).where(F.col("kind").isNotNull()).join(
        assigned(t).where(F.col("variant_id").isNotNull()).select("test_id", "user_id", "variant_id"), ["test_id", "user_id"])
    return ex.rollup(seen)


def filled(t):
    return variants(t).join(counted(t), ["test_id", "variant_id"], "left").fillna(
        0, ["impressions", "clicks", "conversions"])


@query("user_hash", "SELECT test_id, user_id, user_hash FROM ab_hashed")
def _(t):
    return users(t).select("test_id", "user_id", ex.user_hash(F.col("test_id"), F.col("user_id")).alias("user_hash"))


@query("inclusion", """
SELECT test_id, user_id, bucket, bucket % 100 < traffic_allocation * 100 AS included FROM ab_buckets JOIN ab_tests USING (test_id)""")
def _(t):
    b = users(t).join(tests(t), "test_id").withColumn(
        "bucket", ex.bucket(ex.user_hash(F.col("test_id"), F.col("user_id"))))
    return b.select("test_id", "user_id", "bucket", ex.included(F.col("bucket"), F.col("traffic_allocation")).alias("included"))


@query("variant_cumulative_weight", """
SELECT test_id, variant_id, round(low, 6) AS low, round(high, 6) AS high FROM ab_ranges""")
def _(t):
    return ex.variant_ranges(variants(t)).select("test_id", "variant_id", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"))


@query("variant_assignment", "SELECT test_id, user_id, bucket, variant_id FROM ab_assigned")
def _(t):
    return assigned(t).select("test_id", "user_id", "bucket", "variant_id")


@query("sticky_assignment", """
SELECT a.test_id, a.user_id, coalesce(x.variant_id, a.variant_id) AS variant_id
FROM ab_assigned a LEFT JOIN ab_existing x USING (test_id, user_hash)""")
def _(t):
    kept = users(t).where(F.col("user_id") % 6 == 0).select(
        "test_id", ex.user_hash(F.col("test_id"), F.col("user_id")).alias("user_hash"), (F.col("test_id") + 20).alias("variant_id"))
    return ex.assign(users(t), tests(t), variants(t), kept).select("test_id", "user_id", "variant_id")


@query("test_validation", """
SELECT test_id, count(*) AS variants, round(sum(traffic_weight), 6) AS weight FROM ab_variants GROUP BY test_id
HAVING count(*) < 2 OR abs(sum(traffic_weight) - 1) > 0.01""")
def _(t):
    return ex.validate_tests(variants(t)).withColumn("weight", r6(F.col("weight")))


@query("ab_variant_rollup", """
SELECT test_id, variant_id, impressions, clicks, conversions, round(revenue, 6) AS revenue FROM ab_rollup""")
def _(t):
    return counted(t).withColumn("revenue", r6(F.col("revenue")))


Z = "CASE confidence_level WHEN 0.9 THEN 1.645::DOUBLE WHEN 0.95 THEN 1.96::DOUBLE WHEN 0.99 THEN 2.576::DOUBLE ELSE 1.96::DOUBLE END"
cte("ab_control", """
SELECT test_id, variant_id AS c_id, impressions AS c_n, clicks AS c_k FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY NOT is_control, variant_id) AS rn FROM ab_counted) WHERE rn = 1""")
cte("ab_stats", f"""
SELECT *, CASE WHEN impressions > 0 THEN greatest(0, center - spread) ELSE 0 END AS low,
  CASE WHEN impressions > 0 THEN least(1, center + spread) ELSE 0 END AS high FROM (
  SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS center,
    z * sqrt((p * (1 - p) + z * z / (4 * n)) / n) / (1 + z * z / n) AS spread FROM (
    SELECT v.*, c.c_id, c.c_n, c.c_k, t.confidence_level, {Z} AS z, nullif(v.impressions, 0)::DOUBLE AS n,
      v.clicks / nullif(v.impressions, 0)::DOUBLE AS p
    FROM ab_counted v JOIN ab_control c USING (test_id) JOIN ab_tests t USING (test_id)))""")


@query("variant_stats", """
SELECT test_id, variant_id, impressions, clicks, conversions,
  round(CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0 END * 100, 6) AS ctr,
  round(CASE WHEN clicks > 0 THEN conversions / clicks ELSE 0 END * 100, 6) AS conversion_rate,
  round(low * 100, 6) AS ci_low, round(high * 100, 6) AS ci_high,
  round(CASE WHEN variant_id <> c_id AND c_n > 0 AND c_k > 0 THEN
    (CASE WHEN impressions > 0 THEN clicks / impressions ELSE 0 END - c_k / c_n) / (c_k / c_n) * 100 END, 6) AS lift
FROM ab_stats""")
def _(t):
    rows = ex.variant_stats(filled(t), tests(t))
    return rows.select(*[r6(F.col(c)).alias(c) if c in ("ctr", "conversion_rate", "ci_low", "ci_high", "lift") else c
                         for c in rows.columns])


@query("wilson_interval", """
SELECT variant_id, round(low, 6) AS low, round(high, 6) AS high FROM ab_stats""")
def _(t):
    rows = filled(t).join(tests(t), "test_id")
    low, high = stats.wilson_bounds(F.col("clicks"), F.col("impressions"), F.col("confidence_level"))
    return rows.select("variant_id", r6(low).alias("low"), r6(high).alias("high"))


A1, A2, A3, A4, A5 = (f"{a}::DOUBLE" for a in stats.ERF_A)
P_VALUE = f"""CASE WHEN n1 > 0 AND n2 > 0 AND pooled > 0 AND pooled < 1 THEN
    (SELECT 2 * (1 - 0.5 * (1 + (1 - ((((({A5} * u + {A4}) * u) + {A3}) * u + {A2}) * u + {A1}) * u * exp(-w * w))))
     FROM (SELECT w, 1 / (1 + {stats.ERF_P}::DOUBLE * w) AS u FROM (
       SELECT abs(k1 / n1 - k2 / n2) / sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)) / sqrt(2) AS w)))
  ELSE 1.0 END"""
cte("ab_tested", f"""
SELECT *, {P_VALUE} AS p_value FROM (
  SELECT c.test_id, t.status, t.confidence_level, t.min_sample_size, s.total, c.c_id, c.c_n::DOUBLE AS n1, c.c_k::DOUBLE AS k1,
    b.variant_id AS b_id, b.impressions::DOUBLE AS n2, b.clicks::DOUBLE AS k2,
    (c.c_k + b.clicks) / nullif(c.c_n + b.impressions, 0)::DOUBLE AS pooled
  FROM ab_control c JOIN ab_tests t USING (test_id)
  JOIN (SELECT test_id, CAST(sum(impressions) AS BIGINT) AS total FROM ab_counted GROUP BY ALL) s USING (test_id)
  JOIN (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY v.test_id ORDER BY
      CASE WHEN v.impressions > 0 THEN v.clicks / v.impressions ELSE 0 END DESC, v.variant_id) AS rn
    FROM ab_counted v JOIN ab_control c USING (test_id) WHERE v.variant_id <> c.c_id) WHERE rn = 1) b USING (test_id))""")


@query("two_proportion_z", "SELECT test_id, round(p_value, 5) AS p_value FROM ab_tested")
def _(t):
    return ex.test_results(filled(t), tests(t)).select("test_id", F.round("p_value", 5).alias("p_value"))


@query("winner_and_action", """
SELECT test_id, status, total AS total_impressions, round(p_value, 5) AS p_value, sig AS is_significant,
  win AS winner_variant_id, CASE WHEN win IS NOT NULL THEN 'Declare variant ' || win || ' as winner and implement'
  WHEN total < min_sample_size THEN 'Continue test - need ' || (min_sample_size - total) || ' more impressions'
  WHEN NOT sig THEN 'Continue test - no significant difference yet' ELSE 'Review results manually' END AS recommended_action
FROM (SELECT *, CASE WHEN sig AND total >= min_sample_size THEN CASE WHEN
    (CASE WHEN n2 > 0 THEN k2 / n2 ELSE 0 END) > (CASE WHEN n1 > 0 THEN k1 / n1 ELSE 0 END) THEN b_id ELSE c_id END END AS win
  FROM (SELECT *, p_value < 1 - confidence_level AS sig FROM ab_tested))""")
def _(t):
    return ex.test_results(filled(t), tests(t)).withColumn("p_value", F.round("p_value", 5))
