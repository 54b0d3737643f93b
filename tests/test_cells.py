"""Vector search over cells and under filters, against the full product."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidemark.operators import cells


def made(n, width=8, groups=10, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, width))
    return (middle[rng.integers(0, groups, n)] + 0.3 * rng.normal(size=(n, width))).round(3)


def full(q, v, ids, k):
    """The k best of every query by rounded cosine, ties to the smaller id."""
    scores = np.round(cells.unit_rows(q) @ cells.unit_rows(v).T, 6)
    return [[(int(ids[j]), float(s[j])) for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j]))[:k]] for s in scores]


def frame(spark, ids, v, name="vec_id"):
    return spark.createDataFrame([(int(i), [float(c) for c in x]) for i, x in zip(ids, v)], f"{name} bigint, embedding array<double>")


def listed(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_over_cells(spark, block, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK_ROWS", block)
    v = made(300)
    v[5] = 0  # no direction
    v[20:30] = v[19]  # ties
    ids = np.arange(300)[::-1]
    index = cells.build_cells(frame(spark, ids, v), 12, sample=100)
    got = listed(cells.cell_topk(frame(spark, range(40), v[:40], "query_id"), index, 6, probes=2).collect())
    want = full(v[:40], v, ids, 6)
    assert [got[i] for i in range(40)] == want


def test_recall_of_probes(spark, capsys):
    v = np.random.default_rng(4).normal(size=(3000, 16)).round(4)  # no clusters: the hard case
    v[:1500] = made(1500, 16, 40, 2)
    index = cells.build_cells(frame(spark, range(3000), v), 32)
    got = listed(cells.cell_topk(frame(spark, range(0, 3000, 50), v[::50], "query_id"), index, 10, probes=12, exact=False).collect())
    want = full(v[::50], v, np.arange(3000), 10)
    recall = np.mean([len({x for x, _ in got[i * 50]} & {x for x, _ in w}) / 10 for i, w in enumerate(want)])
    with capsys.disabled():
        print(f"\nrecall of 12 of 32 cells: {recall:.3f}")
    assert recall >= 0.9


def test_filters_come_first(spark):
    rng = np.random.default_rng(9)
    v, a, b = made(200, seed=3), rng.integers(0, 4, 200).tolist(), rng.choice(["x", "y"], 200).tolist()
    a[3] = None
    rows = spark.createDataFrame([(i, v[i].tolist(), a[i], b[i]) for i in range(200)], "vec_id bigint, embedding array<double>, a int, b string")
    asked = [(i, v[i].tolist(), [None, 0, 1, 9][i % 4], [None, "x"][i % 2]) for i in range(30)]
    got = listed(cells.filtered_topk(spark.createDataFrame(asked, "query_id bigint, embedding array<double>, a int, b string"), rows, 5, ["a", "b"]).collect())
    for i, x, fa, fb in asked:
        at = [j for j in range(200) if (fa is None or a[j] == fa) and (fb is None or b[j] == fb)]
        assert got.get(i, []) == (full([x], v[at], np.array(at), 5)[0] if at else [])


def test_empty(spark):
    none = frame(spark, [], [])
    assert cells.cell_topk(none.withColumnRenamed("vec_id", "query_id"), cells.build_cells(none), 5).count() == 0
    index = cells.build_cells(frame(spark, [1], [[1.0, 0.0]]))
    assert cells.cell_topk(frame(spark, [], [], "query_id"), index, 5).count() == 0


def test_memory_of_a_block_is_bounded():
    """The scores of a full block are never held at once, and the rows sent to the parts of cells go out in bounded batches."""
    rng = np.random.default_rng(2)
    side = lambda name: pd.DataFrame({name: np.arange(4096), "embedding": list(rng.normal(size=(4096, 16)))})
    queries, vectors = side("query_id"), side("vec_id")
    tracemalloc.start()
    got = cells.nearest_in_block(queries, vectors, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6 and len(got) == 4096 * 5
    x, y = (cells.unit_rows(d["embedding"]) for d in (queries, vectors))
    scores = np.round(x[1000:1040] @ y.T, 6)
    assert (got.vec_id.to_numpy().reshape(-1, 5)[1000:1040] == np.argsort(-scores, axis=1, kind="stable")[:, :5]).all()

    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([[0.5, 0.5]] * 200), pa.array([0] * 200)], names=["query_id", "embedding", "qb"])
    parts = np.array([700, 0, 3])
    row, cell = np.repeat(np.arange(200), 2), np.tile([0, 2], 200)
    out = list(cells.asked_parts(batch, row, cell, parts))
    assert sum(b.num_rows for b in out) == 200 * 703 and max(b.num_rows for b in out) <= cells.ASKED_ROWS
    want = {(q, c, i) for q in range(200) for c in (0, 2) for i in range(parts[c])}
    assert {t for b in out for t in zip(*(b[c].to_pylist() for c in ("query_id", "cell", "part")), strict=True)} == want
