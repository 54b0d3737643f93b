"""Exact top-k search by distributed histogram selection.

Every query is scored against every row, block by block, in integers. Each round counts the scores of a query's current
interval in bins, adds the counts of all blocks, and keeps the one bin that holds the k-th score; after the last round that
bin is a single score. A last pass keeps the scores above it and, of those equal to it, the smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import written

BINS = 4096
EXACT = 2.0**53


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), width)


def _scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles while every partial sum is exact in them, else in 64-bit integers."""
    if len(q) and len(d) and float(np.abs(q).max()) * float(np.abs(d).max()) * q.shape[1] < EXACT:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ d.astype(np.int64).T


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, block: int = 4096, query_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of every query row (vec_id divisible by ``query_every``) against
    every row with another vec_id; ties to the smaller vec_id, fewer rows if there are fewer.

    ``vectors`` needs vec_id, embedding (other columns are ignored). Components become floor(scale * x). Rows with a null id
    or vector, or a null or non-finite component take no part; vectors of different lengths raise an error. Repeated
    rows of one vec_id count once. An empty table gives an empty result. Scores must fit 64 bits.
    """
    spark = vectors.sparkSession
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    rows = written(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "topk-rows")
    n, width, least, most = rows.agg(F.count("*"), F.max(F.size("v")), F.min(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], out)
    if least != width:
        raise ValueError(f"vectors have {least} to {width} components")
    parts, q_parts = max(1, -(-n // block), min(16, n // 256)), max(1, -(-n // query_every // query_block))
    home = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    data = rows.select(home("vec_id", parts).alias("d"), F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("q"), "vec_id", "v")
    asked = rows.filter(F.col("vec_id") % query_every == 0)

    def paired(query: DataFrame) -> tuple:
        """Rows and queries that meet: a block of each, never all in one task."""
        query = query.select(home("vec_id", q_parts).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("d"), "*")
        return data.groupBy("d", "q"), query.groupBy("d", "q")

    def block_scores(left: pa.Table, right: pa.Table):
        if not len(left) or not len(right):
            return
        ids = left["vec_id"].to_numpy()
        d = _matrix(left["v"], width)
        order = np.argsort(ids, kind="stable")
        ids, d = ids[order], d[order]
        for at in range(0, len(right), 256):
            piece = right.slice(at, 256)
            q_ids = piece["vec_id"].to_numpy()
            yield piece, q_ids, ids, _scores(_matrix(piece["v"], width), d), ids[None, :] != q_ids[:, None]

    count_schema = pa.schema([("vec_id", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())])

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [], [], []
        for piece, q_ids, _, s, ok in block_scores(left, right) or ():
            low, step, span, need = (piece[c].to_numpy() for c in ("low", "step", "span", "need"))
            for i in range(len(q_ids)):
                x = s[i][ok[i]] - low[i]
                bins = x[(x >= 0) & (x < span[i])] // step[i]
                if len(bins):
                    got, c = np.unique(bins, return_counts=True)
                    # counts below the bin in which this block alone has enough scores can't matter
                    keep = max(0, len(c) - 1 - int(np.searchsorted(np.cumsum(c[::-1]), need[i])))
                    for o, v in zip(out, (np.full(len(c) - keep, q_ids[i]), got[keep:], c[keep:]), strict=True):
                        o.append(v)
        return pa.table([np.concatenate(o).astype(np.int64) if o else np.array([], np.int64) for o in out], schema=count_schema)

    bound = width * int(most) * int(most) + 1
    step = -(-2 * bound // BINS)
    state = {"low": -bound, "step": step, "span": 2 * bound, "need": k}
    asked = written(asked.select("*", *[F.lit(x).cast("long").alias(c) for c, x in state.items()]), "topk-state")
    while True:
        left, right = paired(asked)
        counts = left.cogroup(right).applyInArrow(count, "vec_id long, bin long, n long").groupBy("vec_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("vec_id").orderBy(F.desc("bin"))
        counts = counts.withColumn("upto", F.sum("n").over(down))
        found = counts.join(asked.select("vec_id", F.col("need").alias("k0")), "vec_id").filter(F.col("upto") >= F.col("k0"))
        found = found.groupBy("vec_id").agg(F.max_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above")), "bin").alias("f"))
        # a query with fewer than k candidates keeps its lowest bin: all its scores pass
        following = -(-step // BINS)
        new = asked.join(found, "vec_id", "left").select(
            "vec_id", "v", (F.col("low") + F.coalesce(F.col("f.bin"), F.lit(0)) * step).alias("low"), F.lit(following).cast("long").alias("step"),
            F.lit(step).cast("long").alias("span"), (F.col("need") - F.coalesce(F.col("f.above"), F.lit(0))).alias("need"))
        asked = written(new, "topk-state")
        if step == 1:
            break
        step = following

    pick_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [], [], []
        for piece, q_ids, ids, s, ok in block_scores(left, right) or ():
            low = piece["low"].to_numpy()
            for i in range(len(q_ids)):
                above = np.flatnonzero(ok[i] & (s[i] > low[i]))
                equal = np.flatnonzero(ok[i] & (s[i] == low[i]))[:k]  # ids are in order, so these are the smallest
                at = np.concatenate([above, equal])
                for o, v in zip(out, (np.full(len(at), q_ids[i]), ids[at], s[i][at]), strict=True):
                    o.append(v)
        return pa.table([np.concatenate(o).astype(np.int64) if o else np.array([], np.int64) for o in out], schema=pick_schema)

    left, right = paired(asked)
    kept = left.cogroup(right).applyInArrow(pick, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
