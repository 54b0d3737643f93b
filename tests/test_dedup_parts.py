"""Greedy removal by word sets: sets meet by equal parts, and words move only for rows that meet."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import dedup, merging


@pytest.mark.parametrize("threshold", [0.9, 0.75, 0.5])
def test_alike_sets_share_a_key(threshold):
    """Pairs at and above the threshold, of sizes from one word to hundreds; few of the others meet."""
    rng = random.Random(11)
    sets, alike = [], []
    while len(sets) < 2400:
        a = rng.sample(range(1 << 60), rng.choice([1, 2, 3, 5, 9, 10, 11, 19, 20, 50, 121, 300]))
        b = a[rng.randrange(len(a) // 6 + 1):] + [rng.randrange(1 << 60, 1 << 61) for _ in range(rng.randrange(len(a) // 6 + 2))]
        alike.append(a != b and len(set(a) & set(b)) / len(set(a) | set(b)) >= threshold)
        sets += [a, b]
    size = np.array([len(s) for s in sets])
    words = dedup.mixed(np.array([w for s in sets for w in s], np.uint64))
    keys, many = dedup.keys_of_parts(words, size, np.zeros(len(sets), np.uint64), threshold)
    held = [set(k.tolist()) for k in np.split(keys, np.cumsum(many)[:-1])]
    assert sum(alike) > 100
    assert all(held[2 * i] & held[2 * i + 1] for i, x in enumerate(alike) if x)
    if threshold == 0.9:
        strangers = sum(bool(held[i] & held[i + 3]) for i in range(0, len(sets) - 3, 2))
        assert strangers < 30


def test_words_move_only_for_rows_that_meet(spark, monkeypatch):
    """Of 200 results, ten resemble an earlier one: words are written for these pairs only, not for all rows."""
    rows = [("q", n, " ".join(f"w{n}x{i}" for i in range(40))) for n in range(190)]
    rows += [("q", 200 + n, c + " more") for _, n, c in rows[:10]]
    written = []

    def seen(step):
        def run(df):
            out = step(df)
            if any(t == "array<string>" for _, t in out.dtypes):
                written.append(out.count())
            return out

        return run

    monkeypatch.setattr(dedup, "cut_lineage", seen(dedup.cut_lineage))
    monkeypatch.setattr(dedup, "stored", seen(dedup.stored))
    df = spark.createDataFrame(rows, "query_id string, row_id bigint, content string")
    assert {r.row_id for r in merging.content_dedup(df).collect()} == set(range(190))
    assert sum(written) <= 20


def test_results_without_words_or_query_stay(spark):
    """As the SQL has it: nothing resembles a null or empty text, and a null query is no group."""
    rows = [("q", 1, None), ("q", 2, ""), ("q", 3, "a b"), ("q", 4, "b  A"), (None, 5, "a b"), (None, 6, "a b"), ("r", 7, "a b")]
    kept = merging.content_dedup(spark.createDataFrame(rows, "query_id string, row_id bigint, content string"))
    assert kept.columns == ["query_id", "row_id", "content"]
    assert {r.row_id for r in kept.where(F.col("row_id") > 0).collect()} == {1, 2, 3, 5, 6, 7}


@pytest.mark.parametrize("pairs", [32, 0.01])
def test_chains_and_families_equal_the_sequential_rule(spark, monkeypatch, pairs):
    """A drifting chain, each alike to its neighbours only, and a family alike to its first: in rounds and by all pairs."""
    monkeypatch.setattr(dedup, "PAIRS", pairs, raising=False)
    rows = [("q", n, [f"c{i}" for i in range(2 * n, 2 * n + 60)]) for n in range(8)]
    rows += [("q", 100 + n, [f"f{i}" for i in range(60)] + [f"n{n}"]) for n in range(12)]
    want = []
    for _, n, w in rows:
        if not any(len(set(w) & set(x)) / len(set(w) | set(x)) >= 0.9 for _, x in want):
            want.append((n, w))
    df = spark.createDataFrame(rows, "q string, n bigint, w array<string>")
    assert sorted(r.n for r in dedup.greedy_jaccard(df, "q", "n", "w", 0.9).collect()) == [n for n, _ in want]
