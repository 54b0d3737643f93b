"""Mixing sources to target weights by entropy balancing.

Document rates w minimise sum(w log w - w) under one token constraint per source, sum(w * size) = target, and w <= cap.
The optimum is an exponential tilt by size, w = min(cap, exp(lambda * size / scale)), with one multiplier per source; the
convex dual is solved by safeguarded Newton steps whose sums Spark computes. Rates are then rounded into whole copies so
that the words taken stay within about half a document of the target.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import SPACE_WORD, written

UNIT = 1_000_000  # rates are rounded to this fraction, so running sums are exact
CAP = 3
PHASES = 32
BROADCAST_SOURCES = 10_000  # rows of a few numbers each; a longer list of sources is joined by a shuffle


def _by_source(docs: DataFrame, rows: DataFrame, n: int, name: str) -> DataFrame:
    """``docs`` with the columns of ``rows``, of which there are ``n``, one for each source (column ``name``)."""
    return docs.join(F.broadcast(rows) if n <= BROADCAST_SOURCES else rows, docs["source"].eqNullSafe(rows[name]))


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (1, 2, 3), cap: float = CAP) -> dict[str | None, float]:
    """Share all sizes among the sources by repeating weights (sources by code point, null last); a target stops at ``cap``
    times its source's size and the excess is shared again by weight until none is above."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, fixed, rest = dict(sizes), {}, float(sum(n for _, n in sizes))
    free = dict(weight)
    while free:
        total = sum(free.values())
        over = [s for s, w in free.items() if rest * w / total > cap * size[s]]
        if not over:
            return fixed | {s: rest * w / total for s, w in free.items()}
        for s in over:
            fixed[s] = float(cap * size[s])
            free.pop(s)
        rest = float(sum(n for _, n in sizes)) - sum(fixed.values())
    return fixed


def _multipliers(docs: DataFrame, goal: dict[str | None, float], scale: dict[str | None, float], cap: float, rounds: int, tol: float):
    """Newton steps on the dual of every source at once: one Spark aggregation per round, one row per source to the driver."""
    spark, log_cap = docs.sparkSession, math.log(cap)
    state = {s: [0.0, -math.inf, math.inf] for s in goal}
    for _ in range(rounds):
        now = spark.createDataFrame([(s, x[0], scale[s]) for s, x in state.items()], "s string, tilt double, scale double")
        z = F.col("size") / F.col("scale")
        rate = F.exp(F.least(F.col("tilt") * z, F.lit(log_cap)))
        inside = F.when(F.col("tilt") * z < log_cap, rate * z * F.col("size")).otherwise(0.0)
        exact = lambda c: F.sum(c.cast("decimal(28,6)")).cast("double")  # noqa: E731  sums that don't depend on their order
        sums = (_by_source(docs, now, len(state), "s").groupBy("source")
                .agg(exact(rate * F.col("size")).alias("got"), exact(inside).alias("slope")).collect())
        off = 0.0
        for r in sums:
            s = state[r["source"]]
            gap = r["got"] - goal[r["source"]]
            if abs(gap) <= tol * max(1.0, goal[r["source"]]):
                continue
            off = max(off, abs(gap))
            s[1 if gap < 0 else 2] = s[0]
            step = s[0] - gap / r["slope"] if r["slope"] > 0 else math.inf * (-1 if gap > 0 else 1)
            if not s[1] < step < s[2] or not math.isfinite(step):  # outside the bracket: halve it, or widen it
                step = (s[1] + s[2]) / 2 if math.isfinite(s[1]) and math.isfinite(s[2]) else (2 * s[0] + 1 if gap < 0 else 2 * s[0] - 1)
            s[0] = step
        if off == 0.0:
            break
    return {s: x[0] for s, x in state.items()}


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = CAP, rounds: int = 60, tol: float = 1e-7) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies (0..cap), taken = copies * size and
    row_hash (xxhash64 of id and text) for every row of ``docs``
    (doc_id, source, text; other columns are ignored).

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, the last one. Repeated rows
    count each for themselves. The rounding order is fixed by size, then a hash of id and text, so reruns agree. An empty
    table gives an empty result. The list of sources (one row each) is held by the driver.
    """
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    docs = docs.select("doc_id", F.col("source").cast("string").alias("source"), words.alias("size"),
                       F.xxhash64("doc_id", "text").alias("h"))
    docs = written(docs, "mix-sizes")
    per = docs.groupBy("source").agg(F.sum("size").alias("n"), (F.sum((F.col("size") * F.col("size")).cast("decimal(28,0)")).cast("double") / F.greatest(F.sum("size"), F.lit(1))).alias("scale")).collect()
    sizes = {r["source"]: int(r["n"]) for r in per}
    goal = targets(list(sizes.items()), weights, cap)
    open_ = {s for s in goal if 0 < goal[s] < cap * sizes[s] * (1 - 1e-12)}
    tilt = _multipliers(docs, {s: goal[s] for s in open_}, {r["source"]: max(r["scale"], 1.0) for r in per}, cap, rounds, tol) if open_ else {}
    scale = {r["source"]: max(r["scale"], 1.0) for r in per}
    rows = [(s, sizes[s], float(goal[s]), float(tilt.get(s, 0.0)), scale[s], s in open_) for s in goal]
    by = docs.sparkSession.createDataFrame(rows, "s string, source_size long, target double, tilt double, scale double, open boolean")
    rate = F.when(F.col("open"), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("scale"), F.lit(math.log(cap))))).otherwise(F.lit(float(cap)))
    docs = _by_source(docs, by, len(rows), "s").withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0))
    docs = docs.withColumn("units", F.least(F.lit(cap * UNIT), F.round(F.col("rate") * UNIT)).cast("long"))
    # A source is cut along the rounding order (size class, then a hash), so that no window spans a whole source; the sum
    # carried into each cut makes the running sum that of the whole source.
    docs = docs.withColumn("cut", F.floor(F.log2(F.col("size") + 1) * 8).cast("int") * 32 + F.pmod("h", F.lit(32)).cast("int"))
    carry = docs.groupBy("source", "cut").agg(F.sum("units").alias("units"))
    before = Window.partitionBy("source").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(F.col("source").alias("s2"), F.col("cut").alias("cut2"), F.coalesce(F.sum("units").over(before), F.lit(0)).alias("carried"))
    docs = docs.join(carry, docs["source"].eqNullSafe(carry["s2"]) & (docs["cut"] == carry["cut2"]))
    inside = Window.partitionBy("source", "cut").orderBy("size", "h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("carried") + F.sum("units").over(inside)
    docs = docs.withColumn("upto", upto)
    # Any starting phase of the rounding keeps the running sums; each source takes the phase that ends nearest its target.
    copies = lambda phase: f"((upto + {phase}) div {UNIT} - (upto - units + {phase}) div {UNIT})"
    docs = written(docs.select("doc_id", "source", "size", "source_size", "target", "rate", "h", "upto", "units"), "mix-rates")
    phases = [UNIT * (2 * i + 1) // (2 * PHASES) for i in range(PHASES)]
    ends = docs.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(F.expr(f"{copies(p)} * size")).alias(f"p{p}") for p in phases]).collect()
    best = [(r["source"], min(phases, key=lambda p: (abs(r[f"p{p}"] - r["target"]), p))) for r in ends]
    docs = _by_source(docs, docs.sparkSession.createDataFrame(best, "s string, phase long"), len(best), "s")
    return docs.select("doc_id", "source", "size", "source_size", "target", "rate", F.expr(f"cast({copies('phase')} as int) as copies"),
                       F.expr(f"cast({copies('phase')} * size as bigint) as taken"), F.col("h").alias("row_hash"))
