"""Centroid clustering over space-filling-curve zone maps.

Vectors of integers are ordered along a Hilbert curve by a distributed range sort and cut into blocks; each block keeps the
box of its least and greatest components. In every round the distance from a box to a centroid is bounded from below and from
above, and only centroids whose lower bound does not exceed the least upper bound are compared with the block's vectors,
exactly, in 64-bit integers. A block with one candidate left is not compared at all. Rounds read the written blocks;
sums are added block by block before they are shuffled, and only centroids, few by definition, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

BLOCK = 1024  # vectors in a block
CURVE_BITS = 4  # bits of each component that place a vector on the curve
LIMIT = 1 << 62

BLOCKS = "ids array<long>, low array<long>, high array<long>, body binary"
_BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("body", pa.binary())])
_SUMS = pa.schema([("cluster", pa.int32()), ("dim", pa.int32()), ("total", pa.int64()), ("n", pa.int64())])
_ASSIGNED = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("compared", pa.int32())])


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Place of every row of ``cells`` (non-negative, below 2**bits) on the Hilbert curve, as bytes in the curve's order.

    The axes turn into the curve's transposed index by undoing the excess work of each level, then by a Gray code.
    """
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = np.uint32(1 << level), np.uint32((1 << level) - 1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(high, low, swap).astype(np.uint32)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] & np.uint32(1 << level)) != 0, np.uint32((1 << level) - 1), np.uint32(0))
    x ^= flip
    planes = np.stack([(x >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])  # level, axis, row
    packed = np.packbits(planes.reshape(bits * n, -1).T.astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def squared_distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids; in doubles while all sums are exact in them."""
    most = max((int(np.abs(a).max()) for a in (rows, centroids) if a.size), default=0)
    if 4 * most * most * max(1, rows.shape[1]) < 1 << 53:
        a, b = rows.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((rows - c) ** 2).sum(1) for c in centroids], axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids that may be nearest to some point of the box: nearest corner no farther than another's farthest corner."""
    below, above = centroids - low, high - centroids
    nearest = (np.maximum(np.maximum(-below, -above), 0) ** 2).sum(1)
    farthest = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(1)
    return np.flatnonzero(nearest <= farthest.min())


def assign(rows: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster (ties: smaller number) and squared distance of every row of a block, and the number of centroids compared."""
    at = candidates(low, high, centroids)
    d = squared_distances(rows, centroids[at])
    best = d.argmin(1)
    return at[best].astype(np.int32), d[np.arange(len(rows)), best], len(at)


def _rows(body: bytes, width: int) -> np.ndarray:
    return np.frombuffer(body, np.int64).reshape(-1, width)


def zone_blocks(vectors: DataFrame, width: int, scale: int, block: int = BLOCK) -> DataFrame:
    """Blocks of vectors near each other on the curve: ids, box and components (64-bit, row after row).

    Vectors with another number of components, null, or with a null or non-finite component are left out. A value whose
    squares could leave 64 bits is an error.
    """
    fine = (F.size("embedding") == width) & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    kept = vectors.filter(F.col("embedding").isNotNull()).filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    kept = written(kept, "zone-vectors")
    n, least, most = kept.agg(F.count("*"), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    if n and ((most - least) ** 2 * width * 4 >= LIMIT or n * max(abs(most), abs(least)) >= LIMIT):
        raise OverflowError(f"{n} vectors with components between {least} and {most} do not fit 64-bit sums and distances")
    span = max(1, (most or 0) - (least or 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch["v"].flatten().to_numpy().reshape(-1, width)
            cells = np.minimum((v - least) * (1 << CURVE_BITS) // (span + 1), (1 << CURVE_BITS) - 1)
            keys = hilbert_keys(cells, CURVE_BITS) if len(v) else []
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(keys, pa.binary())], names=["vec_id", "v", "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        count = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, block - count)
                ids += part["vec_id"].to_pylist()
                held.append(part["v"].flatten().to_numpy().reshape(-1, width))
                at, count = at + part.num_rows, count + part.num_rows
                if count == block:
                    yield pack(ids, np.concatenate(held))
                    ids, held, count = [], [], 0
        if count:
            yield pack(ids, np.concatenate(held))

    def pack(ids: list, v: np.ndarray) -> pa.RecordBatch:
        values = [ids], [v.min(0)], [v.max(0)], [np.ascontiguousarray(v, np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(values, _BLOCKS.types, strict=True)], schema=_BLOCKS)

    # ties on the curve are parted by a hash of the id, so a crowd of equal vectors spreads over tasks
    parts = max(1, -(-n // (64 * block)))
    placed = kept.mapInArrow(place, "vec_id long, v array<long>, key binary").withColumn("part", F.xxhash64("vec_id"))
    placed = placed.repartitionByRange(parts, "key", "part").sortWithinPartitions("key", "part") if parts > 1 else placed.coalesce(1).sortWithinPartitions("key", "part")
    return written(placed.select("vec_id", "v").mapInArrow(cut, BLOCKS), "zone-blocks")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared (centroids compared in its block).

    ``vectors`` needs vec_id, embedding; other columns are ignored. Vectors of ``width`` finite components take part, floored
    after scaling. The k vectors with the smallest sha256 of "seed:vec_id" start; each of ``rounds`` moves every non-empty
    centroid to the floored mean of its vectors. Ties go to the smaller number. A row without vec_id is assigned and counted
    but cannot start; of rows of one vec_id the smallest vector may start. Repeated rows all count. Fewer than k vectors start
    fewer centroids. An empty table, or one without ids, gives an empty result.
    """
    spark = vectors.sparkSession
    blocks = zone_blocks(vectors, width, scale)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k first of each batch of blocks, by hash, then by vector."""
        for batch in batches:
            best = {}
            for ids, body in zip(batch["ids"].to_pylist(), batch["body"].to_pylist(), strict=True):
                v = _rows(body, width)
                for i, x in enumerate(ids):
                    if x is not None:
                        key = hashlib.sha256(f"{seed}:{x}".encode()).hexdigest()
                        row = v[i].tolist()
                        best[key] = min(best.get(key, row), row)
            first = sorted(best.items())[:k]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in first], pa.string()), pa.array([r for _, r in first], pa.list_(pa.int64()))], names=["h", "v"])

    start = blocks.select("ids", "body").mapInArrow(listed, "h string, v array<long>").groupBy("h").agg(F.min("v").alias("v")).orderBy("h").limit(k).collect()
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared int"
    if not start:
        return spark.createDataFrame([], out)
    centroids = np.array([r["v"] for r in sorted(start, key=lambda r: r["h"])], np.int64).reshape(-1, width)

    def sums(centroids: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
            for batch in batches:
                for low, high, body in zip(*(batch[c].to_pylist() for c in ("low", "high", "body")), strict=True):
                    v = _rows(body, width)
                    c, _, _ = assign(v, np.array(low), np.array(high), centroids)
                    for j in np.unique(c):
                        total[j] += v[c == j].sum(0)
                    n += np.bincount(c, minlength=len(n))
            at = np.flatnonzero(n)
            columns = np.repeat(at, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(at)), total[at].reshape(-1), np.repeat(n[at], width)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_SUMS)

        return run

    for _ in range(rounds):
        moved = blocks.select("low", "high", "body").mapInArrow(sums(centroids), "cluster int, dim int, total long, n long")
        moved = moved.groupBy("cluster", "dim").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # k rows of a centroid each
        centroids = centroids.copy()
        for r in moved:
            centroids[r["cluster"], r["dim"]] = r["total"] // r["n"]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, low, high, body in zip(*(batch[c].to_pylist() for c in ("ids", "low", "high", "body")), strict=True):
                c, d, m = assign(_rows(body, width), np.array(low), np.array(high), centroids)
                columns = ids, c, d, np.full(len(c), m)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, _ASSIGNED.types, strict=True)], schema=_ASSIGNED)

    assigned = written(blocks.mapInArrow(final, "vec_id long, cluster int, distance long, compared int"), "zone-assigned")
    inertia = {r["cluster"]: r["x"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("x")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.get(F.array(*[F.lit(x).cast(kind) for x in values]), F.col("cluster"))
    numbers = range(len(centroids))
    return assigned.select("vec_id", "cluster", "distance", of([inertia.get(i, 0) for i in numbers], "long").alias("cluster_inertia"),
                           F.lit(sum(inertia.values())).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"), "compared")
