"""Clusters over zone maps against plain k-means in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from tidemark.llm import zonemap

SCHEMA = "vec_id long, embedding array<float>, ids string, low int, v int"


def brute(rows, k, rounds, width, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v in kept:
        if i is not None:
            h = hashlib.sha256(f"1:{i}".encode()).hexdigest()
            first[h] = min(first.get(h, v), v)
    centroids = [v for _, v in sorted(first.items())[:k]]
    if not centroids:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(col) // len(members[j]) for col in zip(*members[j], strict=True)] if j in members else c for j, c in enumerate(centroids)]
    got = [(i, *near(v)[::-1]) for i, v in kept]
    total = {j: sum(d for _, c, d in got if c == j) for j in range(len(centroids))}
    name = lambda j: hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()
    return sorted(((i, c, d, total[c], sum(total.values()), name(c)) for i, c, d in got), key=repr)


def made(n, width, seed, groups):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, width))
    v = (middle[rng.integers(0, groups, n)] + rng.normal(size=(n, width)) * 0.05).astype(np.float32).astype(float)
    return [(int(i), v[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("width,k", [(2, 3), (8, 5), (3, 16)])
def test_equals_brute_force(spark, width, k, monkeypatch):
    monkeypatch.setattr(zonemap, "BLOCK", 16)
    rows = made(300, width, width, 6)
    rows += [(0, rows[1][1]), (300, rows[0][1]), (300, rows[0][1]), (None, rows[5][1]), (None, None), (301, None), (302, [1.0] * (width + 1)),
             (303, [float("nan")] * width), (304, [float("inf")] + [0.0] * (width - 1)), (305, [None] + [0.0] * (width - 1)), (306, []), (307, [-0.0] * width)] + [(400 + i, [0.5] * width) for i in range(80)]
    df = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA)
    got = zonemap.cluster(df, k=k, width=width)
    assert sorted((tuple(r)[:6] for r in got.collect()), key=repr) == brute(rows, k, 3, width, 64)


def test_boxes_prune(spark):
    """Blocks of vectors that lie together need few of the centroids."""
    rows = made(20_000, 2, 3, 40)
    got = zonemap.cluster(spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], SCHEMA), width=2).agg({"compared": "avg"}).first()[0]
    assert got < 8


def test_curve_visits_every_cell_by_single_steps():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        keys = zonemap.hilbert_keys(cells, bits)
        assert len(set(keys)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=lambda i: keys[i])]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_candidates_hold_the_nearest():
    rng = np.random.default_rng(4)
    for _ in range(200):
        v, c = rng.integers(-20, 20, (6, 5)), rng.integers(-20, 20, (9, 5))
        cluster, d, _ = zonemap.assign(v, v.min(0), v.max(0), c)
        full = ((v[:, None] - c[None]) ** 2).sum(2)
        assert (cluster == full.argmin(1)).all() and (d == full.min(1)).all()
    big = np.array([[1 << 28, -(1 << 28)]])
    assert zonemap.squared_distances(big, -big)[0, 0] == 2 * (1 << 29) ** 2


def test_empty_and_too_large(spark):
    assert zonemap.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert zonemap.cluster(spark.createDataFrame([(None, [1.0, 2.0], "", 0, 0)], SCHEMA), width=2).count() == 0
    with pytest.raises(OverflowError):
        zonemap.cluster(spark.createDataFrame([(1, [1e15, 0.0], "", 0, 0), (2, [0.0, 0.0], "", 0, 0)], SCHEMA), width=2)
