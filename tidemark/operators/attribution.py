"""Multi-touch attribution (J3, WN4).

A conversion meets every click of its session within 30 days. Pairing them row by row is quadratic in a
busy session, so no pair table is built: the weights of all five models follow from a few running sums
per session and per (session, ad), read off at the two ends of each conversion's window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timing import DAY, micros
from tidemark.operators import ordered

MODELS = ["first_touch", "last_touch", "linear", "time_decay", "position_based"]
HALF_LIFE_DAYS = 7  # fixed value
LOOKBACK_DAYS = 30  # fixed value
FIRST_LAST_SHARE, MIDDLE_SHARE = 0.4, 0.2  # fixed values


def touch_sums(conversions: DataFrame, clicks: DataFrame, reference: str, width: int = DAY) -> DataFrame:
    """Per (conversion, ad) the number and decayed weight of touches in the window, and per
    conversion the number of touches and the first and last ad. ``reference`` is any time near the data;
    decay is counted from there so that the running sums stay in range."""
    origin = micros(F.lit(reference).cast("timestamp_ntz"))
    span = LOOKBACK_DAYS * DAY
    touch = clicks.select("click_id", "session_id", "ad_id", micros(F.col("ts")).alias("pos"))
    own = conversions.join(
        clicks.select("click_id", "session_id", F.col("ad_id").alias("own_ad")), "click_id").select(
            "conversion_id", "session_id", "own_ad", F.coalesce("value", F.lit(0.0)).alias("value"),
            micros(F.col("ts")).alias("pos"))

    # candidate ads of a conversion: the distinct ads of its session, not its clicks
    session_ads = touch.select("session_id", "ad_id").distinct()
    wanted = own.join(session_ads, "session_id").select("conversion_id", "session_id", "ad_id", "pos")
    ends = wanted.select(
        "conversion_id", "session_id", "ad_id",
        F.explode(F.array(
            F.struct(F.col("pos").alias("pos"), F.lit(1).alias("sign")),
            F.struct((F.col("pos") - F.lit(span + 1)).alias("pos"), F.lit(-1).alias("sign")))).alias("e")).select(
                "conversion_id", "session_id", "ad_id", "e.pos", "e.sign",
                F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("decay"))
    grown = F.pow(F.lit(2.0), (F.col("pos") - origin) / F.lit(float(HALF_LIFE_DAYS * DAY)))
    marks = touch.select(F.lit(None).cast("bigint").alias("conversion_id"), "session_id", "ad_id", "pos",
                         F.lit(0).alias("sign"), F.lit(1).cast("bigint").alias("n"), grown.alias("decay"))
    sums = ordered.prefix_sums(marks.unionByName(ends), ["session_id", "ad_id"], "pos", ["n", "decay"], width)
    counted = (sums.where(F.col("conversion_id").isNotNull()).groupBy("conversion_id", "ad_id")
               .agg(F.sum(F.col("n") * F.col("sign")).alias("touches"),
                    F.sum(F.col("decay") * F.col("sign")).alias("decay"))
               .where(F.col("touches") > 0))

    # last touch: latest click up to the conversion; first touch: the same search in mirrored time
    last = ordered.asof_last(own.select("session_id", "pos", "conversion_id"),
                             touch.select("session_id", "pos", F.struct("click_id", "ad_id").alias("fact")),
                             ["session_id"], "pos", "fact", width, False, "last")
    first = ordered.asof_last(own.select("session_id", (F.lit(span) - F.col("pos")).alias("pos"), "conversion_id"),
                              touch.select("session_id", (-F.col("pos")).alias("pos"),
                                           F.struct((-F.col("click_id")).alias("click_id"), "ad_id").alias("fact")),
                              ["session_id"], "pos", "fact", width, False, "first")
    return own.select("conversion_id", "own_ad", "value").join(
        last.select("conversion_id", F.col("last.ad_id").alias("last_ad")), "conversion_id").join(
        first.select("conversion_id", F.col("first.ad_id").alias("first_ad")), "conversion_id").join(
        counted, "conversion_id", "left")


def attribute(conversions: DataFrame, clicks: DataFrame, reference: str) -> DataFrame:
    """WN4: one row per (conversion, ad, model). First and last touch keep their zero-weight ads; a
    conversion whose window holds no click is credited to its own click."""
    sums = touch_sums(conversions, clicks, reference)
    lonely = F.col("touches").isNull()
    filled = sums.select(
        "conversion_id", "value", F.coalesce("ad_id", "own_ad").alias("ad_id"),
        F.coalesce("touches", F.lit(1)).alias("touches"), F.coalesce("decay", F.lit(1.0)).alias("decay"),
        F.when(lonely, F.col("own_ad")).otherwise(F.col("first_ad")).alias("first_ad"),
        F.when(lonely, F.col("own_ad")).otherwise(F.col("last_ad")).alias("last_ad"))
    totals = filled.groupBy("conversion_id").agg(F.sum("touches").alias("n"), F.sum("decay").alias("decay_total"))
    all_ = filled.join(totals, "conversion_id")
    is_first = (F.col("ad_id") == F.col("first_ad")).cast("int")
    is_last = (F.col("ad_id") == F.col("last_ad")).cast("int")
    middle = F.col("touches") - is_first - is_last
    position = (F.when(F.col("n") == 1, F.lit(1.0)).when(F.col("n") == 2, F.col("touches") / 2)
                .otherwise(FIRST_LAST_SHARE * (is_first + is_last)
                           + MIDDLE_SHARE * middle / F.greatest(F.col("n") - 2, F.lit(1))))
    weight = {"first_touch": is_first.cast("double"), "last_touch": is_last.cast("double"),
              "linear": F.col("touches") / F.col("n"), "time_decay": F.col("decay") / F.col("decay_total"),
              "position_based": position}
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), w.alias("weight")) for m, w in weight.items()]))
    return all_.select("conversion_id", "ad_id", "value", models.alias("m")).select(
        "conversion_id", "ad_id", "m.model", "m.weight", (F.col("m.weight") * F.col("value")).alias("attributed_value"))
