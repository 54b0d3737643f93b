"""Vector search over coarse cells, and under tag filters (V2).

A cell holds the vectors nearest to one centroid. Centroids are trained on a bounded sample; every vector is indexed. A search
probes the cells nearest to a query. That alone is approximate; the exact form then opens the cells that the probes left and
that may still hold a better vector, by the angle between query and centroid and the widest angle inside the cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.session import cut_lineage

BLOCK_ROWS = 4096  # vectors, or queries, that meet in one task at least
WIDE = 16  # a block may have so many times BLOCK_ROWS rows
HELD_VALUES = 1 << 22  # but not more than so many numbers, unless BLOCK_ROWS rows have more
SCORED_ROWS = 512  # queries of a block that are scored at once
TILE_ROWS = 2048  # with so many vectors
ASKED_ROWS = 1 << 15  # rows that one query batch sends on at once
SAMPLE = 65_536  # vectors the centroids are trained on, at most
MAX_CELLS = 1024
ROUNDS = 8
SLACK = 1e-6  # scores are rounded to six places
FOUND = "query_id bigint, vec_id bigint, score double"


def unit_rows(rows: Sequence) -> np.ndarray:
    """Rows as a matrix of unit vectors; a zero vector stays zero."""
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows]) if len(rows) else np.zeros((0, 0))
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores of each row, ties to the smaller column; only what reaches the k-th is sorted."""
    held = np.ones(scores.shape, bool)
    if scores.shape[1] > k:
        held = scores >= -np.partition(-scores, k - 1, axis=1)[:, k - 1:k]
    row, col = np.nonzero(held)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    few = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[few], col[few]


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as a matrix of unit vectors; a zero vector stays zero."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if not len(lists):
        return np.zeros((0, 0))
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    if (size != size[0]).any():
        raise ValueError("vectors differ in length")
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), int(size[0]))
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def exact_scores(x: np.ndarray, y: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Rounded scores of pairs of rows, a bounded number at a time."""
    step, out = max(1, HELD_VALUES // 4 // max(1, x.shape[1])), np.zeros(len(row))
    for at in range(0, len(row), step):
        out[at:at + step] = np.einsum("ij,ij->i", x[row[at:at + step]], y[col[at:at + step]])
    return np.round(out, 6)


def first_of_rows(row: np.ndarray, order: Sequence[np.ndarray], k: int) -> np.ndarray:
    """Places of the k first entries of each row by the keys of ``order``, most important first; sorted by row."""
    at = np.lexsort((*reversed(order), row))
    held = row[at]
    return at[np.arange(len(held)) - np.searchsorted(held, held) < k]


def first_of_crowd(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest rounded scores of each row, ties to the smaller column, in any order: scores of six
    places and columns make one whole number."""
    n = scores.shape[1]
    whole = np.rint(scores * 1e6).astype(np.int64) * n + np.arange(n - 1, -1, -1)
    k = min(k, n)
    return np.repeat(np.arange(len(scores)), k), np.argpartition(whole, n - k, axis=1)[:, n - k:].ravel()


def reached_by(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that k scores reach at least: the k-th highest of the maxima of groups of columns."""
    groups = max(8 * k, 64)
    size = scores.shape[1] // groups
    if not size:
        groups, size = scores.shape[1], 1
    if groups < k:
        return np.full(len(scores), -np.inf, np.float32)
    highest = scores[:, :groups * size].reshape(len(scores), size, groups).max(axis=1)
    return np.partition(highest, groups - k, axis=1)[:, groups - k]


def best_pairs(x: np.ndarray, y: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k best of each row of unit vectors, ties to the smaller column; with ``floor`` only scores that reach it.

    Single precision finds the pairs that may be among the best, by a bound on its error, and double precision settles them.
    """
    error = (x.shape[1] + 8) * 2.0 ** -24
    margin, found = 2 * error + 2e-6, []
    plain = not (np.isfinite(x).all() and np.isfinite(y).all())
    narrow_y = y.astype(np.float32)
    many = 8 * k + 64
    scored, reached = (np.empty(SCORED_ROWS * TILE_ROWS, kind) for kind in (np.float32, bool))
    for at in range(0, len(x), SCORED_ROWS):
        wide = x[at:at + SCORED_ROWS]
        if plain:
            scores = np.round(wide @ y.T, 6)
            row, col = best_of(np.where(np.isnan(scores), -np.inf, scores), k)
            value = scores[row, col]
        else:
            q = wide.astype(np.float32)
            low = np.full(len(q), -np.inf, np.float32)
            if floor is not None:
                low = np.where(np.isnan(floor[at:at + SCORED_ROWS]), -np.inf, floor[at:at + SCORED_ROWS] - margin).astype(np.float32)
            rows, cols, near, tidy = [], [], [], 2
            for n, start in enumerate(range(0, len(y), TILE_ROWS), 1):
                tile = narrow_y[start:start + TILE_ROWS]
                s, hit = (b[:len(q) * len(tile)].reshape(len(q), len(tile)) for b in (scored, reached))
                np.matmul(q, tile.T, out=s)
                if n == 1 and not np.isfinite(low).all():
                    low = np.maximum(low, reached_by(s, k) - np.float32(margin))
                np.greater_equal(s, low[:, None], out=hit)
                crowd = best = place = np.zeros(0, np.int64)
                if np.count_nonzero(hit) > many:
                    crowd = np.flatnonzero(np.count_nonzero(hit, axis=1) > many)
                if len(crowd):  # many equals: the k best of the tile are settled at once
                    best, place = first_of_crowd(wide[crowd] @ y[start:start + TILE_ROWS].T, k)
                    hit[crowd] = False
                r, c = np.divmod(np.flatnonzero(hit), s.shape[1])
                r, c = np.concatenate([r, crowd[best]]), np.concatenate([c, place])
                rows.append(r), cols.append(c + start), near.append(s[r, c])
                if n == tidy and start + TILE_ROWS < len(y):
                    tidy *= 2
                    row, col, value = (np.concatenate(p) for p in (rows, cols, near))
                    last = first_of_rows(row, [-value], k)
                    full = np.bincount(row[last], minlength=len(q)) == k
                    kth = np.full(len(q), np.inf, np.float32)
                    np.minimum.at(kth, row[last], value[last])
                    low = np.maximum(low, np.where(full, kth - np.float32(margin), -np.inf)).astype(np.float32)
                    rest = value >= low[row]
                    rows, cols, near = [row[rest]], [col[rest]], [value[rest]]
            row, col = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (rows, cols))
            value = exact_scores(wide, y, row, col)
            best = first_of_rows(row, [-value, col], k)
            row, col, value = row[best], col[best], value[best]
        if floor is not None:
            reach = ~(value < floor[at + row])
            row, col, value = row[reach], col[reach], value[reach]
        found.append((row + at, col, value))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def nearest_in_block(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    if len(queries) == 0 or len(vectors) == 0:
        return pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], np.float64)})
    vectors = vectors.sort_values("vec_id", ignore_index=True)
    row, col, score = best_pairs(unit_rows(queries["embedding"]), unit_rows(vectors["embedding"]), k)
    return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[row], "vec_id": vectors["vec_id"].to_numpy()[col], "score": score})


def nearest_in_tables(queries: pa.Table, vectors: pa.Table, k: int) -> pa.Table:
    """The k best vectors (query_id, vec_id, score) of every query of a block; with a column floor, those that reach it."""
    names, row, col, score = ["query_id", "vec_id", "score"], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if queries.num_rows and vectors.num_rows:
        vectors = vectors.sort_by("vec_id")
        floor = queries["floor"].to_numpy() if "floor" in queries.column_names else None
        row, col, score = best_pairs(matrix(queries["embedding"]), matrix(vectors["embedding"]), k, floor)
    return pa.table([pa.array(queries["query_id"].to_numpy()[row], pa.int64()), pa.array(vectors["vec_id"].to_numpy()[col], pa.int64()), pa.array(score, pa.float64())], names=names)


def most_rows(dims: int, least: int) -> int:
    """Rows of the largest block of vectors of so many dimensions."""
    return least * max(1, min(WIDE, HELD_VALUES // (least * max(1, dims))))


def block_counts(queries: int, vectors: int, dims: int, tasks: int, least: int) -> tuple[int, int]:
    """Blocks of queries and of vectors: as few as their largest size allows, as each row goes to all blocks of the other
    side, but so many that there is work for all tasks."""
    per = [max(1, min(n, most_rows(dims, least))) for n in (queries, vectors)]
    blocks = lambda: [max(1, -(-n // p)) for n, p in zip((queries, vectors), per, strict=True)]
    while blocks()[0] * blocks()[1] < tasks and max(per) > least:
        i = per.index(max(per))
        per[i] = max(least, -(-per[i] // 2))
    return blocks()[0], blocks()[1]


def tasks_wanted(spark: SparkSession) -> int:
    """Blocks that keep all cores at work: some for each core, as they end at different times."""
    return 4 * spark.sparkContext.defaultParallelism


def asked_parts(batch: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The queries ``row`` of a batch once for every part of the cells they open, in batches of about ASKED_ROWS rows."""
    step = max(1, ASKED_ROWS // max(1, int(parts.max())))
    for start in range(0, len(row), step):
        r, c = row[start:start + step], cell[start:start + step]
        at = np.repeat(np.arange(len(r)), parts[c])
        part = np.arange(len(at)) - np.repeat(np.cumsum(parts[c]) - parts[c], parts[c])
        take = pa.array(r[at])
        yield pa.RecordBatch.from_arrays([*[batch[n].take(take) for n in batch.schema.names], pa.array(c[at].astype(np.int32)), pa.array(part.astype(np.int32))],
                                         names=[*batch.schema.names, "cell", "part"])


def train_centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids of at most ``cells`` cells, by spherical k-means over a sample: the ``sample`` rows of least hash."""
    chosen = vectors.where("embedding IS NOT NULL").select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(sample)
    x = unit_rows(chosen.toPandas()["embedding"])
    x = np.unique(x[np.abs(x).sum(1) > 0], axis=0) if len(x) else x
    if not len(x):
        return np.zeros((0, 0))
    at = [0]  # each start is the row least like those chosen before
    near = x @ x[0]
    while len(at) < min(cells, MAX_CELLS, len(x)):
        at.append(int(near.argmin()))
        near = np.maximum(near, x @ x[at[-1]])
    centroids = x[at]
    for _ in range(rounds):
        cell = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.where(length > 0, length, 1), centroids)
    return centroids


@dataclass
class CellIndex:
    """Inverted lists (cell, part, vec_id, embedding); a cell of many rows has several parts."""

    centroids: np.ndarray
    lists: DataFrame
    parts: list[int]  # parts of each cell; zero for a cell without rows
    widest: np.ndarray  # least cosine inside each cell


def build_cells(vectors: DataFrame, cells: int = 64, sample: int = SAMPLE) -> CellIndex:
    """Index every vector (vec_id, embedding; null embeddings are left out). The driver holds one row per cell."""
    vectors = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding")
    centroids = train_centroids(vectors, cells, sample)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch["embedding"])
            near = x @ centroids.T if len(centroids) and len(x) else np.zeros((len(x), 1))
            cell = near.argmax(1) if len(x) else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(x)), cell])],
                                             names=["vec_id", "embedding", "cell", "near"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    placed = cut_lineage(vectors.mapInArrow(place, f"vec_id bigint, embedding {kind}, cell int, near double"))
    sizes = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).collect()}
    many = max(1, len(centroids))
    most = most_rows(centroids.shape[1], BLOCK_ROWS)
    parts = [-(-sizes[c]["n"] // most) if c in sizes else 0 for c in range(many)]
    widest = np.array([sizes[c]["near"] if c in sizes else 1.0 for c in range(many)])
    part = F.pmod(F.xxhash64("vec_id"), F.greatest(F.lit(1), F.get(F.array(*[F.lit(p) for p in parts]), F.col("cell")))).cast("int")
    return CellIndex(centroids, placed.select("cell", part.alias("part"), "vec_id", "embedding"), parts, widest)


def cell_topk(queries: DataFrame, index: CellIndex, k: int, probes: int = 4, exact: bool = True) -> DataFrame:
    """V2: query_id, vec_id, score, rank: the k nearest vectors by cosine, ties to the smaller id.

    ``queries`` has query_id, embedding. With ``exact`` the result is that of ``vector_topk``; without, that of the ``probes``
    nearest cells. A query meets a cell's part in one task, queries of a busy cell in blocks.
    """
    centroids, parts, widest = index.centroids, np.array(index.parts), index.widest
    spark = queries.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], FOUND + ", rank int")
    queries = queries.where("embedding IS NOT NULL").select("query_id", "embedding")
    tasks = tasks_wanted(spark)
    blocks = block_counts(queries.count(), 1, centroids.shape[1], -(-tasks // max(1, int(parts.sum()))), BLOCK_ROWS)[0]
    queries = queries.withColumns({"floor": F.lit(float("nan")), "qb": F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")})
    kind = queries.schema["embedding"].dataType.simpleString()
    meet, groups = ["cell", "part", "qb"], 2 * max(tasks, blocks * int(parts.sum()))

    def ask(bounded: bool, rows: bool):
        """The queries once for every part of the cells that they open, or the different (qb, cell, part) of these alone."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for batch in batches:
                if not batch.num_rows:
                    continue
                near = matrix(batch["embedding"]) @ centroids.T
                near[:, parts == 0] = -2.0
                row, cell = best_of(near, probes)
                if bounded:
                    reach = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip(widest, -1, 1))[None, :]))
                    floor = batch["floor"].to_numpy(zero_copy_only=False)
                    left = (np.isnan(floor)[:, None] | (reach >= floor[:, None] - SLACK)) & (parts > 0)[None, :]
                    left[row, cell] = False
                    row, cell = np.nonzero(left)
                if rows:
                    yield from asked_parts(batch, row, cell, parts)
                    continue
                pairs = set(zip(batch["qb"].to_numpy()[row].tolist(), cell.tolist(), strict=True)) - seen
                seen |= pairs
                new = [(b, c, p) for b, c in pairs for p in range(parts[c])]
                if new:
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in zip(*new, strict=True)], names=["qb", "cell", "part"])

        return run

    def search(wanting: DataFrame, bounded: bool) -> DataFrame:
        # lists go to the blocks of queries that ask for them, and only to those
        asked = wanting.mapInArrow(ask(bounded, True), f"query_id bigint, embedding {kind}, floor double, qb int, cell int, part int").repartition(groups, *meet)
        wanted = wanting.mapInArrow(ask(bounded, False), "qb int, cell int, part int").distinct()
        lists = index.lists.join(wanted, ["cell", "part"]).select(*[F.col(c).alias(c) for c in (*meet, "vec_id", "embedding")]).repartition(groups, *meet)
        found = asked.groupBy(*meet).cogroup(lists.groupBy(*meet)).applyInArrow(lambda a, b: nearest_in_tables(a, b, k), FOUND)
        return ordered.top_k(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)

    first = search(queries, False)
    if not exact:
        return first
    first = cut_lineage(first)
    floors = first.where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    known = queries.drop("floor").join(floors, "query_id", "left").select("query_id", "embedding", F.coalesce("floor", F.lit(float("nan"))).alias("floor"), "qb")
    every = first.unionByName(search(known, True)).drop("rank")
    return ordered.top_k(every, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)


def filtered_topk(queries: DataFrame, vectors: DataFrame, k: int, tags: Sequence[str]) -> DataFrame:
    """V2 with tag filters: as ``vector_topk``, over the vectors whose tags equal the query's, decided before any scoring.

    ``queries`` has query_id, embedding and a column for each tag; null asks for any value. ``vectors`` has vec_id, embedding
    and the tags. Vectors lie in blocks of one combination of tags. A combination is listed under every pattern of asked
    tags that fits it, so queries find their blocks by an equi join on the patterns.
    """
    vectors = vectors.where("embedding IS NOT NULL").select("vec_id", "embedding", *tags)
    queries = queries.where("embedding IS NOT NULL").select("query_id", "embedding", *tags)
    sizes = cut_lineage(vectors.groupBy(*tags).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts")).withColumn("combo", F.xxhash64(*tags)))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in tags]
    placed = vectors.join(sizes, same(vectors, sizes)).select("combo", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "embedding")
    patterns = [[c for i, c in enumerate(tags) if m >> i & 1] for m in range(1 << len(tags))]
    fits = F.array(*[F.struct(*[(F.col(c) if c in asked else F.lit(None).cast(vectors.schema[c].dataType)).alias(c) for c in tags], F.lit(m).alias("mask")) for m, asked in enumerate(patterns)])
    listed = sizes.withColumn("fit", F.explode(fits)).select("combo", "parts", "fit")
    mask = sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(tags)), F.lit(0))
    asked = queries.withColumn("mask", mask)
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    met = asked.join(listed, [asked["mask"] == listed["fit.mask"], *[asked[c].eqNullSafe(listed[f"fit.{c}"]) for c in tags]])
    met = met.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("qb"), "combo", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    lists = placed.join(met.select("combo", "part", "qb").distinct(), ["combo", "part"]).select(*[F.col(c).alias(c) for c in ("combo", "part", "qb", "vec_id", "embedding")])
    found = met.groupBy("combo", "part", "qb").cogroup(lists.groupBy("combo", "part", "qb")).applyInPandas(lambda a, b: nearest_in_block(a, b, k), FOUND)
    return ordered.top_k(found, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)
