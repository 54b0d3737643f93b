"""A/B assignment and statistics (X1-X9, A13, WN7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.hashing import md5_mod

BUCKETS = 10_000  # fixed value
WEIGHT_TOLERANCE = 0.01  # fixed value


def user_hash(test_id: Column, user: Column) -> Column:
    """X1."""
    return F.sha2(F.concat_ws(":", test_id.cast("string"), user.cast("string")), 256)


def bucket(hash_: Column) -> Column:
    """Number 0-9999 of a user in a test; inclusion and variant choice both read it."""
    return md5_mod(hash_, BUCKETS)


def included(bucket_: Column, allocation: Column) -> Column:
    """X2."""
    return (bucket_ % 100) < allocation * 100


def validate_tests(variants: DataFrame) -> DataFrame:
    """Tests with fewer than two variants, or weights that do not sum to 1."""
    sums = variants.groupBy("test_id").agg(F.count(F.lit(1)).alias("variants"), F.sum("traffic_weight").alias("weight"))
    return sums.where((F.col("variants") < 2) | (F.abs(F.col("weight") - 1.0) > WEIGHT_TOLERANCE))


def variant_ranges(variants: DataFrame) -> DataFrame:
    """WN7: [low, high) of each variant in id order; the last one also takes what is left over."""
    order = Window.partitionBy("test_id").orderBy("variant_id")
    upto = F.sum("traffic_weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.lead("variant_id").over(order).isNull()
    return variants.select(
        "test_id", "variant_id", (upto - F.col("traffic_weight")).alias("low"),
        F.when(last, F.greatest(upto, F.lit(1.0))).otherwise(upto).alias("high"))


def assign(users: DataFrame, tests: DataFrame, variants: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Variant of each (test, user) of a running test; an existing assignment wins.

    The few ranges of a test travel as one array, so every user row joins exactly one row and the
    choice is a filter on that array.
    """
    ranges = variant_ranges(variants).groupBy("test_id").agg(
        F.array_sort(F.collect_list(F.struct("high", "variant_id"))).alias("ranges"))
    running = tests.where(F.col("status") == "running").select("test_id", "traffic_allocation").join(ranges, "test_id")
    hashed = users.withColumn("user_hash", user_hash(F.col("test_id"), F.col("user_id"))).join(running, "test_id")
    placed = hashed.withColumn("bucket", bucket(F.col("user_hash")))
    point = F.col("bucket") / float(BUCKETS)
    chosen = F.element_at(F.filter("ranges", lambda r: point < r["high"]), 1)["variant_id"]
    fresh = F.when(included(F.col("bucket"), F.col("traffic_allocation")), chosen)
    if existing is not None:
        placed = placed.join(existing.select("test_id", "user_hash", F.col("variant_id").alias("_kept")),
                             ["test_id", "user_hash"], "left")
        fresh = F.coalesce("_kept", fresh)
    return placed.select("test_id", "user_id", "user_hash", "bucket", fresh.alias("variant_id"))


def rollup(events: DataFrame) -> DataFrame:
    """Counters per variant from events with a ``kind`` of impression, click or conversion."""
    kind = F.col("kind")
    return events.groupBy("test_id", "variant_id").agg(
        F.count_if(kind == "impression").alias("impressions"), F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "conversion").alias("conversions"),
        F.coalesce(F.sum(F.when(kind == "conversion", F.col("value"))), F.lit(0.0)).alias("revenue"))


def _rate(clicks: str, shown: str) -> Column:
    return F.when(F.col(shown) > 0, F.col(clicks) / F.col(shown)).otherwise(0.0)


def with_control(variants: DataFrame) -> DataFrame:
    """Every variant row beside its test's control (flagged, else the first by id)."""
    control = variants.groupBy("test_id").agg(F.min_by(
        F.struct("variant_id", "impressions", "clicks"), F.struct((~F.col("is_control")).alias("a"), "variant_id")).alias("c"))
    return variants.join(control, "test_id")


def variant_stats(variants: DataFrame, tests: DataFrame) -> DataFrame:
    """Rates, interval and lift of each variant, in percent."""
    rows = with_control(variants).join(tests.select("test_id", "confidence_level"), "test_id")
    ctr, control_ctr = _rate("clicks", "impressions"), F.col("c.clicks") / F.col("c.impressions")
    low, high = stats.wilson_bounds(F.col("clicks"), F.col("impressions"), F.col("confidence_level"))
    lift = F.when((F.col("variant_id") != F.col("c.variant_id")) & (F.col("c.impressions") > 0) & (F.col("c.clicks") > 0),
                  (ctr - control_ctr) / control_ctr * 100)
    return rows.select("test_id", "variant_id", "impressions", "clicks", "conversions", (ctr * 100).alias("ctr"),
                       (_rate("conversions", "clicks") * 100).alias("conversion_rate"), (low * 100).alias("ci_low"),
                       (high * 100).alias("ci_high"), lift.alias("lift"))


def test_results(variants: DataFrame, tests: DataFrame) -> DataFrame:
    """Best challenger against control, winner and what to do next, one row per test."""
    rows = with_control(variants).withColumn("ctr", _rate("clicks", "impressions"))
    challenger = F.when(F.col("variant_id") != F.col("c.variant_id"),
                        F.struct("variant_id", "impressions", "clicks", "ctr"))
    order = F.when(F.col("variant_id") != F.col("c.variant_id"), F.struct("ctr", (-F.col("variant_id")).alias("o")))
    best = rows.groupBy("test_id").agg(
        F.sum("impressions").alias("total_impressions"), F.first("c").alias("c"),
        F.max_by(challenger, order).alias("b"))
    joined = best.join(tests, "test_id")
    p = F.when(F.col("b").isNotNull(), stats.two_proportion_p(
        F.col("c.clicks"), F.col("c.impressions"), F.col("b.clicks"), F.col("b.impressions")))
    tested = joined.withColumn("p_value", p).withColumn(
        "is_significant", F.coalesce(F.col("p_value") < 1 - F.col("confidence_level"), F.lit(False)))
    enough = F.col("total_impressions") >= F.col("min_sample_size")
    control_ctr = F.when(F.col("c.impressions") > 0, F.col("c.clicks") / F.col("c.impressions")).otherwise(0.0)
    winner = F.when(F.col("is_significant") & enough,
                    F.when(F.col("b.ctr") > control_ctr, F.col("b.variant_id")).otherwise(F.col("c.variant_id")))
    won = tested.withColumn("winner_variant_id", winner)
    action = (
        F.when(F.col("winner_variant_id").isNotNull(), F.concat(
            F.lit("Declare variant "), F.col("winner_variant_id").cast("string"), F.lit(" as winner and implement")))
        .when(~enough, F.concat(F.lit("Continue test - need "),
                                (F.col("min_sample_size") - F.col("total_impressions")).cast("string"),
                                F.lit(" more impressions")))
        .when(~F.col("is_significant"), "Continue test - no significant difference yet")
        .otherwise("Review results manually"))
    return won.select("test_id", "status", "total_impressions", "p_value", "is_significant", "winner_variant_id",
                      action.alias("recommended_action"))
