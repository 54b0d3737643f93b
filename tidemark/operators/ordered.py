"""Ordered logic over keys of any size.

A window over a whole key puts that key into one task. When one key can hold a third of all rows that
task never ends, so the operators here cut every key into buckets of the order column, run a plain
window inside each bucket, and add what the earlier buckets carry over. The carried part is one small
row per (key, bucket). All results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored


def prefix_sums(points: DataFrame, keys: Sequence[str], pos: str, deltas: Sequence[str],
                width: int | Column) -> DataFrame:
    """Replace each column of ``deltas`` by its sum over rows of the same keys with position <= own.

    ``pos`` is a bigint; rows with an equal position count each other. Key columns must not be null.
    """
    width = width if isinstance(width, Column) else F.lit(width)
    cut = points.withColumn("_bucket", F.floor(F.col(pos) / width))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(pos).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    per_bucket = cut.groupBy(*keys, "_bucket").agg(*[F.sum(d).alias(f"_t_{d}") for d in deltas])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{d}").over(earlier), F.lit(0)).alias(f"_c_{d}") for d in deltas])
    summed = cut.select("*", *[F.sum(d).over(inside).alias(f"_i_{d}") for d in deltas])
    joined = summed.join(carried, [*keys, "_bucket"])
    others = [c for c in points.columns if c not in deltas]
    return joined.select(*others, *[(F.col(f"_i_{d}") + F.col(f"_c_{d}")).alias(d) for d in deltas])


def trailing_counts(events: DataFrame, event_id: str, pos: str,
                    checks: Sequence[tuple[str, Sequence[str], int, int]]) -> DataFrame:
    """Per event, how many events of the same key lie in the trailing window (both ends included).

    ``checks`` lists (output column, key columns, window length, bucket width), lengths in the unit of
    ``pos``. All checks share one shuffle: every event becomes two points per check, one at its own
    position and one just before the window start, and the count is the difference of the two prefix
    sums. A null key gives a null count.
    """
    points = []
    for name, keys, length, width in checks:
        key = F.concat_ws("\u0001", *[F.col(k).cast("string") for k in keys])
        usable = F.lit(True)
        for k in keys:
            usable = usable & F.col(k).isNotNull()
        for at, delta, sign in ((F.col(pos), 1, 1), (F.col(pos) - F.lit(length + 1), 0, -1)):
            points.append(F.when(usable, F.struct(
                F.lit(name).alias("check"), key.alias("key"), at.alias("pos"), F.lit(width).cast("bigint").alias("width"),
                F.lit(delta).cast("bigint").alias("n"), F.lit(sign).cast("bigint").alias("sign"))))
    exploded = events.select(F.col(event_id), F.explode(F.array_compact(F.array(*points))).alias("p")).select(
        event_id, "p.*")
    summed = prefix_sums(exploded, ["check", "key"], "pos", ["n"], F.col("width"))
    return summed.groupBy(event_id).agg(*[
        F.sum(F.when(F.col("check") == name, F.col("n") * F.col("sign"))).alias(name) for name, *_ in checks])


def trailing_distinct(events: DataFrame, event_id: str, key: str, value: str, pos: str, length: int,
                      width: int, name: str) -> DataFrame:
    """Per event, how many distinct values its key showed in the trailing window.

    Each occurrence of a value is live from its position until the window has passed or the value shows
    up again, whichever is first; live spans of one value never overlap, so the number of live spans at
    a position is the number of distinct values. Spans are +1 / -1 points, summed by prefix.
    """
    seen = events.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(key, value, F.col(pos).alias("_p"))
    cut = seen.withColumn("_b", F.floor(F.col("_p") / F.lit(length)))
    # the next occurrence matters only within `length`, so it is in this bucket or the first of the next one
    heads = cut.groupBy(key, value, "_b").agg(F.min("_p").alias("_p")).select(
        key, value, "_p", (F.col("_b") - 1).alias("_b"), F.lit(True).alias("_marker"))
    both = cut.withColumn("_marker", F.lit(False)).unionByName(heads)
    following = Window.partitionBy(key, value, "_b").orderBy("_p", "_marker")
    spans = (both.withColumn("_next", F.lead("_p").over(following)).where(~F.col("_marker"))
             .select(key, F.col("_p").alias("_start"),
                     F.least(F.col("_p") + F.lit(length + 1), F.coalesce("_next", F.lit(2 ** 62))).alias("_end")))
    deltas = spans.select(key, F.explode(F.array(
        F.struct(F.col("_start").alias("_p"), F.lit(1).cast("bigint").alias("_n")),
        F.struct(F.col("_end").alias("_p"), F.lit(-1).cast("bigint").alias("_n")))).alias("d")).select(
            key, "d._p", "d._n", F.lit(None).cast("bigint").alias("_id"))
    probes = events.where(F.col(key).isNotNull()).select(
        key, F.col(pos).alias("_p"), F.lit(0).cast("bigint").alias("_n"), F.col(event_id).cast("bigint").alias("_id"))
    summed = prefix_sums(deltas.unionByName(probes), [key], "_p", ["_n"], width)
    return summed.where(F.col("_id").isNotNull()).select(F.col("_id").alias(event_id), F.col("_n").alias(name))


def asof_last(probes: DataFrame, facts: DataFrame, keys: Sequence[str], pos: str, value: str, width: int,
              strict: bool, out: str) -> DataFrame:
    """For each probe, ``value`` of the latest fact of the same keys at or before it (before it if strict).

    Both inputs carry ``keys`` and ``pos`` (bigint); ``value`` is any column of ``facts`` and must not be
    null; among facts at one position the largest value is the latest. Null when there is none.
    """
    probe_cols = [c for c in probes.columns if c not in keys and c != pos]
    left = probes.select(*keys, pos, F.struct(*probe_cols).alias("_probe"), F.lit(0 if strict else 1).alias("_kind"),
                         F.lit(None).cast(facts.schema[value].dataType).alias("_fact"))
    right = facts.select(*keys, pos, F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"),
                         F.lit(1 if strict else 0).alias("_kind"), F.col(value).alias("_fact"))
    both = left.unionByName(right).withColumn("_bucket", F.floor(F.col(pos) / F.lit(width)))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(pos, "_kind", "_fact").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    per_bucket = both.groupBy(*keys, "_bucket").agg(
        F.max(F.when(F.col("_fact").isNotNull(), F.struct(pos, "_fact"))).alias("_latest"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select(*keys, "_bucket", F.last("_latest", ignorenulls=True).over(earlier).alias("_carry"))
    found = both.withColumn("_inside", F.last("_fact", ignorenulls=True).over(inside)).where(
        F.col("_probe").isNotNull())
    return found.join(carried, [*keys, "_bucket"]).select(
        *keys, pos, "_probe.*", F.coalesce("_inside", "_carry._fact").alias(out))


def ranked(rows: DataFrame, keys: Sequence[str], score: str, tie: str, out: str = "rank",
           steps: int = 1000) -> DataFrame:
    """Number rows 1..n per key by score descending, then tie ascending.

    A key is cut by score level (``steps`` levels per unit), so that even a key that holds most of the
    rows is sorted by many tasks. Rows without score come last; rows without a key form a key of their own.
    The rows are stored, as both the levels' counts and the rows themselves are read: pass only the columns that are needed.
    """
    level = F.coalesce(F.floor(-F.col(score) * F.lit(steps)), F.lit(2**62))
    cut = stored(rows).withColumns({"_key": F.struct(*keys), "_level": level})
    inside = Window.partitionBy("_key", "_level").orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    per_level = cut.groupBy("_key", "_level").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy("_key").orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_level.select("_key", "_level", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    # a struct equals another one with the same nulls, so that the rows meet the counts where the window has put them
    numbered = cut.withColumn("_in", F.row_number().over(inside)).join(carried, ["_key", "_level"])
    return numbered.withColumn(out, F.col("_in") + F.col("_above")).drop("_key", "_level", "_in", "_above")


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per key. Spark limits each input partition before the shuffle, so a large key is
    already down to k rows per task when it arrives."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], largest: bool = False) -> DataFrame:
    """One row per key, smallest (or largest) by order. A hash aggregate with partial results, not a
    window, so large keys shrink before the shuffle."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    pick = F.max_by if largest else F.min_by
    picked = rows.groupBy(*keys).agg(pick(whole, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_row"))
    return picked.select("_row.*")
