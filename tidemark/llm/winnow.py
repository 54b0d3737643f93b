"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Texts become arrays of word hashes. A fingerprint is the smallest hash of SPAN words within a sliding window, so two texts
that share a whole window always share a fingerprint at the same place in it. Fingerprints of documents and benchmark items
are joined, and each hit is extended word by word to both sides; it counts if the shared span is long enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, written

WINDOW = 10
SPAN = 4
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_FINGERPRINTS = 200_000  # about 200 bytes each: 40 MB


def words(text: Column) -> Column:
    """Hashes of the words, lower-cased A-Z; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_A_WORD)
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _at(array: str, index: Column | str) -> str:
    return f"get({array}, {index})"


def fingerprints(df: DataFrame, length: int, keep: list[str]) -> DataFrame:
    """Rows of ``df`` (column ``h``: word hashes) for each fingerprint of windows of ``length`` words: ``keep``, ``at`` (first
    word), ``fp`` and ``around``, the hashes of the words up to ``length - span`` to either side (null beyond the ends)."""
    span = min(SPAN, length)
    wide = length - span + 1
    have = span
    exprs, grams = [], "h"
    # grams of 1, 2, 4 words by doubling, then the last step overlaps
    size = 1
    while size < have:
        step = min(size, have - size)
        exprs.append(("g", f"transform(slice({grams}, 1, greatest(0, size({grams}) - {step})), (x, i) -> xxhash64(x, {_at(grams, f'i + {step}')}))"))
        grams, size = "g", size + step
    for name, e in exprs:
        df = df.withColumn(name, F.expr(e))
    if grams == "h":
        df = df.withColumn("g", F.col("h"))
    # the smallest of each window, by doubling
    df, low, size = df.withColumn("m", F.col("g")), "m", 1
    while size < wide:
        step = min(size, wide - size)
        df = df.withColumn("m", F.expr(f"transform(slice({low}, 1, greatest(0, size({low}) - {step})), (x, i) -> least(x, {_at(low, f'i + {step}')}))"))
        size += step
    first = "CASE " + " ".join(f"WHEN {_at('g', f'i + {o}')} = x THEN i + {o}" for o in range(wide)) + " END"
    df = df.withColumn("p", F.expr(f"transform(m, (x, i) -> {first})"))
    df = df.withColumn("p", F.expr("filter(p, (x, i) -> i = 0 OR x <> get(p, i - 1))"))
    side = length - span
    around = f"transform(sequence({-side}, {length - 1}), o -> CASE WHEN x + o >= 0 THEN {_at('h', 'x + o')} END)"
    return (df.withColumn("f", F.expr(f"transform(p, x -> struct(x AS at, {_at('g', 'x')} AS fp, {around} AS around))"))
            # explode() would push the test for an empty array, and with it all of the above, down to the scan once more
            .select(*keep, F.explode_outer("f").alias("f")).filter("f IS NOT NULL").select(*keep, "f.at", "f.fp", "f.around"))


def _reach(length: int) -> tuple[str, str]:
    """Equal words directly left of and right of the shared span."""
    span = min(SPAN, length)
    side = length - span
    if not side:
        return "0", "0"
    left = "CASE " + " ".join(f"WHEN NOT coalesce(around[{side - 1 - j}] = b_around[{side - 1 - j}], false) THEN {j}" for j in range(side)) + f" ELSE {side} END"
    right = "CASE " + " ".join(f"WHEN NOT coalesce(around[{side + span + j}] = b_around[{side + span + j}], false) THEN {j}" for j in range(side)) + f" ELSE {side} END"
    return left, right


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_words, n_hit (words inside any occurrence of a benchmark window), items
    (sorted item_ids, as strings, with an occurring window) and contaminated.

    ``benchmark`` needs item_id, text. A window is ``window`` consecutive item words; a shorter item is one window of its
    own length, an item without words is none. Other columns are ignored. A null text has no words. Rows of docs are told
    apart by id and text; repeated rows are all returned. Empty tables give rows without hits, or no rows.
    """
    docs = docs.select("doc_id", "text")
    items = written(benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("h"))
                    .filter("size(h) > 0").withColumn("length", F.least(F.size("h"), F.lit(window))), "winnow-items")
    lengths = sorted(r[0] for r in items.select("length").distinct().collect())  # at most ``window`` values
    read = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("h"))
    hits = None
    for n in lengths:
        side = n - min(SPAN, n)
        marks = fingerprints(items.filter(F.col("length") == n), n, ["item_id"]).withColumn("near", F.xxhash64("around"))
        marks = written(marks, "winnow-marks")
        # equal surroundings of a fingerprint are one mark, whatever the number of items that hold it
        shapes = marks.groupBy("fp", "near").agg(F.first("around").alias("b_around")).withColumnRenamed("fp", "b_fp")
        if shapes.count() <= BROADCAST_FINGERPRINTS:
            shapes = F.broadcast(shapes)
        found = fingerprints(read, n, ["doc_id", "key"]).join(shapes, F.col("fp") == F.col("b_fp"))
        left, right = _reach(n)
        found = found.withColumn("l", F.expr(left)).withColumn("r", F.expr(right)).filter(F.col("l") + F.col("r") >= side)
        found = found.select("doc_id", "key", "fp", "near", (F.col("at") - F.col("l")).alias("start"), (F.col("at") + F.lit(n - side) + F.col("r")).alias("end"))
        found = found.withColumn("n", F.lit(n))
        hits = found if hits is None else hits.unionByName(found)
        marks = marks.select("item_id", "fp", "near", F.lit(n).alias("n"))
        holders = marks if n == lengths[0] else holders.unionByName(marks)
    n_words = F.size(F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), NOT_A_WORD), lambda w: w != "")).cast("long")
    base = docs.withColumn("key", F.xxhash64("text")).withColumn("n_words", n_words)
    if hits is None:
        return base.select("doc_id", "text", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    hits = written(hits, "winnow-hits")
    covered = hits.select("doc_id", "key", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("w")).distinct().groupBy("doc_id", "key").agg(F.count("*").alias("n_hit"))
    holders = holders.distinct()
    listed = (hits.select("doc_id", "key", "fp", "near", "n").distinct().join(holders, ["fp", "near", "n"])
              .groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    both = covered.join(listed, [covered["doc_id"].eqNullSafe(listed["doc_id"]), covered["key"].eqNullSafe(listed["key"])]).select(
        covered["doc_id"].alias("d"), covered["key"].alias("k"), "n_hit", "items")
    return base.join(both, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("key").eqNullSafe(F.col("k")), "left").select(
        "doc_id", "text", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"))
