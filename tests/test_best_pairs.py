"""The k best pairs of two blocks of vectors: single precision chooses, double precision decides."""

import re

import numpy as np
import pytest

from tidemark.operators import cells, retrieval


def plain(x, y, k, floor=None):
    s = np.round(x @ y.T, 6)
    order = np.argsort(-np.where(np.isnan(s), -np.inf, s), axis=1, kind="stable")[:, :k]
    return [(i, int(j), s[i, j]) for i in range(len(x)) for j in order[i] if floor is None or not s[i, j] < floor[i]]


@pytest.mark.parametrize("k, rows, columns, dims", [(5, 70, 900, 12), (1, 33, 401, 64), (40, 20, 30, 8), (3, 9, 2, 4), (700, 12, 900, 6)])
def test_equals_the_full_product(monkeypatch, k, rows, columns, dims):
    monkeypatch.setattr(cells, "SCORED_ROWS", 16)
    monkeypatch.setattr(cells, "TILE_ROWS", 64)
    monkeypatch.setattr(cells, "HELD_VALUES", 1 << 9)
    rng = np.random.default_rng(k)
    x, y = rng.normal(size=(rows, dims)), rng.normal(size=(columns, dims))
    y[columns // 2:] = y[:columns - columns // 2] + rng.normal(size=(columns - columns // 2, dims)) * 10.0 ** -rng.integers(3, 9, (columns - columns // 2, 1))  # hardly apart
    y[columns // 3:columns // 2] = x[0]  # a crowd of equals
    x[1:4] = x[0]
    y[0] = 0
    x, y = cells.unit_rows(x), cells.unit_rows(y)
    want = plain(x, y, k)
    assert list(zip(*(c.tolist() for c in cells.best_pairs(x, y, k)), strict=True)) == want
    floor = np.round(np.sort(x @ y.T, axis=1)[:, -min(2, columns)], 6)
    floor[5] = np.nan
    assert list(zip(*(c.tolist() for c in cells.best_pairs(x, y, k, floor)), strict=True)) == plain(x, y, k, floor)
    x[2, 1] = np.nan
    got = list(zip(*(c.tolist() for c in cells.best_pairs(x, y, k)), strict=True))
    assert [(i, j) for i, j, _ in got] == [(i, j) for i, j, _ in plain(x, y, k)]


def test_blocks_grow_so_that_rows_are_copied_less(spark, monkeypatch):
    """640 vectors in blocks of 16 rows at least: each row went to 40 blocks."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    m = np.random.default_rng(1).normal(size=(640, 4))
    v = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id bigint, embedding array<float>")
    top = retrieval.vector_topk(v.withColumnRenamed("vec_id", "query_id"), v, 3)
    blocks = [int(n) for n in re.findall(r"pmod\(xxhash64\(\w+#\d+L?, 42\), (\d+)\)", top._jdf.queryExecution().optimizedPlan().toString())]
    assert blocks and max(blocks) <= 10
    n = np.float32(m).astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    got = {(r.query_id, r["rank"]): r.vec_id for r in top.collect()}
    assert got == {(i, at % 3 + 1): j for at, (i, j, _) in enumerate(plain(n, n, 3))}


def test_no_block_beyond_its_bound():
    for n, dims in ((600_000, 64), (600_000, 1536), (51_282, 64), (3, 64), (1, 1)):
        q, v = cells.block_counts(n, n, dims, 48, 4096)
        rows = -(-n // q), -(-n // v)
        assert max(rows) * dims <= max(cells.HELD_VALUES, 4096 * dims) and (q * v >= 48 or max(rows) <= 4096)


@pytest.mark.parametrize("wide", [16, 1])
def test_cells_of_several_parts(spark, monkeypatch, wide):
    monkeypatch.setattr(cells, "BLOCK_ROWS", 9)
    monkeypatch.setattr(cells, "WIDE", wide, raising=False)
    v = np.random.default_rng(8).normal(size=(300, 5)).round(1)
    v[50:90] = v[0]
    frame = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    index = cells.build_cells(frame, 4)
    got = {(r.query_id, r["rank"]): r.vec_id for r in cells.cell_topk(frame.withColumnRenamed("vec_id", "query_id"), index, 4, probes=1).collect()}
    n = cells.unit_rows(np.float32(v))
    assert got == {(i, at % 4 + 1): j for at, (i, j, _) in enumerate(plain(n, n, 4))}
