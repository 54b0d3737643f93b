"""Whitening against a dense eigendecomposition in Python integers and doubles."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, n string, x int, deviation int"


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA).repartition(parts)


def check(rows, got):
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x, n = [v for _, v in kept], len(kept)
    sums = [sum(c) for c in zip(*x, strict=True)]
    away = [[n * a - s for a, s in zip(v, sums, strict=True)] for v in x]
    y = np.array([[float(Fraction(a, n)) for a in v] for v in away])
    values, directions = np.linalg.eigh(y.T @ y / n)
    values, directions = values[::-1], directions[:, ::-1]
    m = max(r.component for r in got)
    assert len(got) == n * m and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    for k in range(m):
        z = y @ directions[:, k] / math.sqrt(values[k])
        want = sorted(zip([sum(a * a for a in v) for v in away], [i is None for i, _ in kept], [i or 0 for i, _ in kept], z.tolist(), strict=True))
        mine = sorted((r.deviation, r.vec_id is None, r.vec_id or 0, r.whitened) for r in got if r.component == k + 1)
        assert [w[:3] for w in want] == [w[:3] for w in mine]
        a, b = np.array([w[3] for w in want]), np.array([w[3] for w in mine])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        share = {r.explained for r in got if r.component == k + 1}
        assert len(share) == 1 and abs(share.pop() / (values[k] / values.sum()) - 1) < 1e-9


@pytest.mark.parametrize("width,batch", [(3, 1 << 14), (12, 5), (40, 64)])
def test_equals_dense(spark, width, batch, monkeypatch):
    monkeypatch.setattr(whiten, "BATCH", batch)
    monkeypatch.setattr(whiten, "FAN_IN", 2)
    rng = np.random.default_rng(width)
    v = (rng.normal(size=(400, width)) * np.geomspace(2, 0.1, width) @ np.linalg.qr(rng.normal(size=(width, width)))[0]).astype(np.float32)
    rows = [(i, x.astype(float).tolist()) for i, x in enumerate(v)]
    rows += [(None, rows[0][1]), (5, rows[5][1]), (901, None), (902, [float("nan")] + [0.0] * (width - 1)), (903, [None] + [0.0] * (width - 1)), (904, [float("-inf")] * width)] + [(1000 + i, rows[7][1]) for i in range(150)]
    check(rows, whiten.whitened(frame(spark, rows, 6)).collect())


def test_low_rank_single_and_empty(spark):
    rows = [(i, [float(i % 7), 2.0 * (i % 7), 1.0, float(i % 3)]) for i in range(50)]
    got = whiten.whitened(frame(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2}
    check(rows, got)
    assert whiten.whitened(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whiten.whitened(frame(spark, [(i, [1.0, 2.0]) for i in range(5)])).count() == 0
    assert whiten.whitened(frame(spark, [(1, None)])).count() == 0 and whiten.whitened(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lengths_and_size_are_errors(spark):
    with pytest.raises(ValueError):
        whiten.whitened(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    with pytest.raises(Exception, match="64 bits"):
        whiten.whitened(frame(spark, [(1, [1e13]), (2, [-1e13])])).collect()


@pytest.mark.parametrize("kind", ["spread", "repeated", "rank one", "small integers"])
def test_updates_equal_scatter(kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 10)) * np.geomspace(1, 1e-4, 10)
    if kind == "repeated":
        x = np.repeat(x[:3], 40, axis=0)
    elif kind == "rank one":
        x = np.outer(x[:, 0], np.arange(10.0))
    elif kind == "small integers":
        x = rng.integers(0, 2, (120, 10)).astype(float)
    s, other = whiten.Spectrum(10), whiten.Spectrum(10)
    for row in x[:50]:  # one row at a time
        s.combine(1, row, np.zeros((0, 10)))
    other.add(x[50:])
    s.merge(other)
    v = np.cov(x.T, bias=True) * len(x)
    assert np.abs((s.vectors * s.values) @ s.vectors.T - v).max() < 1e-11 * np.abs(v).max()
    assert np.abs(s.vectors.T @ s.vectors - np.eye(10)).max() < 1e-12 and np.allclose(s.mean, x.mean(0))
