"""Ordered operators against brute force, with one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup, ordered, retrieval

RNG = random.Random(7)
ROWS = [(i, "hot" if RNG.random() < 0.7 else f"k{i % 5}", RNG.randrange(0, 4000), RNG.choice("abcd")) for i in range(300)]


def frame(spark):
    return spark.createDataFrame(ROWS, "id bigint, k string, pos bigint, v string")


def test_prefix_sums(spark):
    got = {r.id: r.n for r in ordered.prefix_sums(frame(spark).withColumn("n", F.lit(1).cast("bigint")), ["k"], "pos", ["n"], 97).collect()}
    assert got == {i: sum(1 for _, k2, p2, _ in ROWS if k2 == k and p2 <= p) for i, k, p, _ in ROWS}


def test_trailing_counts_include_both_ends(spark):
    out = ordered.trailing_counts(frame(spark), "id", "pos", [("a", ("k",), 100, 33), ("b", ("k", "v"), 500, 50)]).collect()
    for r in out:
        _, k, p, v = ROWS[r.id]
        assert r.a == sum(1 for _, k2, p2, _ in ROWS if k2 == k and p - 100 <= p2 <= p)
        assert r.b == sum(1 for _, k2, p2, v2 in ROWS if (k2, v2) == (k, v) and p - 500 <= p2 <= p)


def test_trailing_distinct(spark):
    out = ordered.trailing_distinct(frame(spark), "id", "k", "v", "pos", 60, 25, "n").collect()
    assert len(out) == len(ROWS)
    for r in out:
        _, k, p, _ = ROWS[r.id]
        assert r.n == len({v2 for _, k2, p2, v2 in ROWS if k2 == k and p - 60 <= p2 <= p})


def test_asof_last_strict_and_not(spark):
    facts = frame(spark).where("id % 3 = 0").select("k", "pos", F.col("id").alias("fact"))
    probes = frame(spark).where("id % 3 = 1").select("k", "pos", "id")
    for strict in (True, False):
        for r in ordered.asof_last(probes, facts, ["k"], "pos", "fact", 111, strict, "found").collect():
            ok = [(p2, i2) for i2, k2, p2, _ in ROWS if i2 % 3 == 0 and k2 == r.k and (p2 < r.pos if strict else p2 <= r.pos)]
            assert r.found == (max(ok)[1] if ok else None)


def test_ranked_matches_sort(spark):
    df = frame(spark).select("k", "id", (F.col("pos") / 4000.0).alias("score"))
    got = {r.id: r["rank"] for r in ordered.ranked(df, ["k"], "score", "id", steps=7).collect()}
    for key in {k for _, k, _, _ in ROWS}:
        want = [i for i, _, _, _ in sorted((r for r in ROWS if r[1] == key), key=lambda r: (-r[2], r[0]))]
        assert [got[i] for i in want] == list(range(1, len(want) + 1))


def greedy(items, similar):
    kept = []
    for i, x in items:
        if not any(similar(y, x) for _, y in kept):
            kept.append((i, x))
    return {i for i, _ in kept}


def test_greedy_jaccard_equals_sequential_rule(spark):
    rng = random.Random(3)
    base = [f"w{j}" for j in range(40)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(40)] = f"x{rng.randrange(30)}"
        rows.append(("hot" if i % 4 else "cold", i, sorted(set(words)) if i % 29 else []))
    df = spark.createDataFrame(rows, "q string, n bigint, w array<string>")
    got = {(r.q, r.n) for r in dedup.greedy_jaccard(df, "q", "n", "w", 0.9).collect()}
    jac = lambda a, b: bool(a and b) and len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.9
    want = {(q, i) for q in ("hot", "cold") for i in greedy([(n, w) for k, n, w in rows if k == q], jac)}
    assert got == want


def test_greedy_blocks_equals_sequential_rule(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else "cold", i, rng.random()) for i in range(50)]
    df = spark.createDataFrame(rows, "q string, n bigint, x double")
    near = lambda a, b: F.abs(a["x"] - b["x"]) < 0.02
    got = {(r.q, r.n) for r in dedup.greedy_blocks(df, "q", "n", ["x"], near, block=16).collect()}
    want = {(q, i) for q in ("hot", "cold")
            for i in greedy([(n, x) for k, n, x in rows if k == q], lambda a, b: abs(a - b) < 0.02)}
    assert got == want


def test_vector_topk_over_several_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    m = np.random.default_rng(1).normal(size=(60, 8))
    m[5] = 0
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id bigint, embedding array<float>")
    out = retrieval.vector_topk(v.withColumnRenamed("vec_id", "query_id"), v, 3).collect()
    n = np.float32(m).astype(float)
    length = np.linalg.norm(n, axis=1, keepdims=True)
    n = np.divide(n, length, out=np.zeros_like(n), where=length > 0)
    s = np.round(n @ n.T, 6)
    for q in range(60):
        want = sorted(range(60), key=lambda j: (-s[q, j], j))[:3]
        assert [r.vec_id for r in sorted((r for r in out if r.query_id == q), key=lambda r: r["rank"])] == want


def test_greedy_jaccard_rounds_do_not_grow_with_a_common_word(spark, monkeypatch):
    """Rows that share their longest words only do not wait for each other, round after round."""
    common = [f"averyveryverylongword{i}" for i in range(6)]
    rows = [("q", n, common + [f"n{n}x{i}" for i in range(34)]) for n in range(40)]
    rows += [("q", 100 + n, w[:39] + ["other"]) for _, n, w in rows[:10]]  # 39 of 41 words alike
    cuts, cut = [], dedup.cut_lineage
    monkeypatch.setattr(dedup, "cut_lineage", lambda df: cuts.append(1) or (cut(df) if len(cuts) < 12 else pytest.fail("too many rounds")))
    got = {r.n for r in dedup.greedy_jaccard(spark.createDataFrame(rows, "q string, n bigint, w array<string>"), "q", "n", "w", 0.9).collect()}
    assert got == set(range(40))
