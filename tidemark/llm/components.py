"""Connected components of a graph that is only ever held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

TASK_EDGES = 1 << 15  # edges of a task; fewer edges than tasks of this size take fewer tasks


def _fit(df: DataFrame, edges: int) -> DataFrame:
    """The frame in as many partitions as ``edges`` rows need, if that is less than a shuffle makes: every task of a round
    leaves a file of each of its shuffles and checkpoints."""
    parts = max(1, -(-edges // TASK_EDGES))
    return df.coalesce(parts) if parts < int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node with an edge (columns a, b, longs); root is the smallest node reachable.

    Alternates large and small stars: each round ties every node's larger, then smaller, neighbours to its smallest one.
    A hub's smallest neighbour is found by partial aggregates; its edges then meet in one join key, which the adaptive skew
    join cuts. Every round is cut off its
    lineage in the shared checkpoint folder; the driver reads two numbers per round, and by the count of edges a round takes
    no more tasks than it needs. Rounds end when one changes nothing; if ``rounds`` are not enough for that, it raises.
    """
    e = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, n = None, e.count()
    for _ in range(rounds):
        e = _fit(e, n)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = cut_lineage(_fit(_fit(large, n).distinct(), n))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = _fit(large.join(low, "u"), n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                             F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut_lineage(_fit(down.filter("u <> v").distinct(), n))
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state:
            break
        state, n = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
