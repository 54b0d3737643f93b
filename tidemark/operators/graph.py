"""Link graph, PageRank and crawl frontier."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.session import bucketed, cut_lineage, stored

DAMPING, ITERATIONS, TOLERANCE = 0.85, 20, 0.001  # fixed values
FAN_OUT, MOST_HUBS = 1 << 12, 1 << 16  # links of a page in one list, or more where over MOST_HUBS pages would have to be split


def link_to_page(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Source page ids to URLs."""
    return links.join(pages.select(F.col("page_id").alias("source_page_id"), F.col("url").alias("src")), "source_page_id").select(
        "src", F.col("target_url").alias("dst"))


def vertices(edges: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """L1: pages and link ends, each once. Edges keep their multiplicity."""
    ends = edges.select(F.col("src").alias("url")).union(edges.select(F.col("dst").alias("url")))
    if pages is not None:
        ends = ends.union(pages.select("url"))
    return ends.distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """L2."""
    both = edges.select(F.explode(F.array(
        F.struct(F.col("src").alias("url"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst").alias("url"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    return both.groupBy("url").agg(F.sum("o").alias("out_links"), F.sum("i").alias("in_links"))


def _number(url: str, seed: int) -> Column:
    """Number of a page; null for a null URL, which no edge reaches."""
    return F.when(F.col(url).isNotNull(), F.xxhash64(F.lit(seed), F.col(url)))


def pagerank(edges: DataFrame, pages: DataFrame | None = None, damping: float = DAMPING, iterations: int = ITERATIONS,
             tolerance: float = TOLERANCE, tol_mode: str = "sum", check_every: int = 1) -> DataFrame:
    """L3: damped rank without redistribution from pages that link nowhere, scores normalised to sum 1.

    Pages go by numbers (64-bit hashes of the URL, taken anew with another seed should two ever be equal). The targets of a
    page are laid out once, as one list per page and multiplicity, in the partition where the page's rank arrives, so a round
    moves ranks to the lists and partial sums to the targets, and no edge. A page with very many in-links is summed by
    partial aggregates; the targets of a page with very many out-links are split over several lists. Every round is written
    to the checkpoint folder, so the plan stays short and a lost executor costs one round. ``tol_mode`` "sum"
    stops on the total change, which means the same at every size; "mean" on the mean change per page, which
    is small at once in a large graph. A tolerance of 0 runs every round without looking.
    """
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("url"), F.lit(1).alias("out")),
                                          F.struct(F.col("dst").alias("url"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    if pages is not None:
        ends = ends.union(pages.select("url", F.lit(0).alias("out")))
    nodes = stored(ends.groupBy("url").agg(F.sum("out").alias("out")))
    n, named, links = nodes.agg(F.count(F.lit(1)), F.count("url"), F.sum("out")).first()
    if n == 0:
        return nodes.select("url").withColumn("rank", F.lit(0.0))
    seed = next(s for s in count() if nodes.agg(F.countDistinct(_number("url", s))).first()[0] == named)
    fan = max(FAN_OUT, links // MOST_HUBS)
    parts = F.ceil(F.col("out") / fan)
    hubs = F.broadcast(nodes.where(F.col("out") > fan).select(_number("url", seed).alias("src"), parts.alias("parts")))  # at most MOST_HUBS rows
    pairs = edges.select(_number("src", seed).alias("src"), _number("dst", seed).alias("dst")).dropna()
    pairs = pairs.join(hubs, "src", "left").select("src", F.coalesce(F.pmod("dst", "parts"), F.lit(0)).alias("part"), "dst")
    lists = pairs.repartition(width, "src", "part").groupBy("src", "part", "dst").agg(F.count(F.lit(1)).alias("m"))
    lists, table = bucketed(lists.groupBy("src", "part", "m").agg(F.collect_list("dst").alias("dsts")), width, "src", "part")
    ranks = nodes.select(_number("url", seed).alias("id"), "out", F.lit(1.0 / n).alias("rank"))
    ranks = cut_lineage(ranks)
    for step in range(1, iterations + 1):
        sent = ranks.where(F.col("out") > 0).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), (F.col("rank") / F.col("out")).alias("each"))
        flow = lists.join(sent.hint("shuffle_hash"), ["src", "part"]).select(F.explode("dsts").alias("dst"), (F.col("each") * F.col("m")).alias("each"))
        flow = flow.groupBy("dst").agg(F.sum("each").alias("flow"))
        moved = cut_lineage(ranks.join(flow, ranks.id == flow.dst, "left").select(
            "id", "out", F.col("rank").alias("old"), (F.lit((1 - damping) / n) + F.lit(damping) * F.coalesce("flow", F.lit(0.0))).alias("rank")))
        ranks = moved.select("id", "out", "rank")
        if tolerance > 0 and step % check_every == 0:
            change = moved.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).first()["d"]
            if (change / n if tol_mode == "mean" else change) < tolerance:
                break
    edges.sparkSession.sql(f"DROP TABLE {table}")
    total = ranks.agg(F.sum("rank").alias("t")).scalar()
    ranks = nodes.select("url", _number("url", seed).alias("id")).join(ranks.withColumnRenamed("id", "of"), F.col("id").eqNullSafe(F.col("of")))
    return ranks.select("url", F.when(total > 0, F.col("rank") / total).otherwise(F.col("rank")).alias("rank"))


def store_pagerank(pages: DataFrame, ranks: DataFrame) -> DataFrame:
    """L4: pages with their rank; a page without one keeps 0."""
    return pages.join(ranks, "url", "left").withColumn("pagerank", F.coalesce("rank", F.lit(0.0))).drop("rank")


def top_pages(ranks: DataFrame, n: int) -> DataFrame:
    """L5."""
    return ranks.orderBy(F.col("rank").desc(), "url").limit(n)


# ---------------------------------------------------------------- frontier
def unvisited(urls: DataFrame, visited: DataFrame) -> DataFrame:
    """P13."""
    return urls.join(visited.select("url"), "url", "left_anti")


def frontier_add(queue: DataFrame, urls: DataFrame, visited: DataFrame, priority: int, depth: int, scheduled_at: str) -> DataFrame:
    """Queue with the new URLs; a URL that waits already, or was visited, is not added again."""
    fresh = unvisited(unvisited(urls.select("url").distinct(), visited), queue).select(
        "url", F.lit(priority).alias("priority"), F.lit(depth).alias("depth"), F.lit("pending").alias("status"),
        F.lit(scheduled_at).cast("timestamp_ntz").alias("scheduled_at"))
    return queue.unionByName(fresh)


def frontier_next(queue: DataFrame, n: int) -> DataFrame:
    """Next pending URLs, highest priority first, then oldest."""
    return queue.where(F.col("status") == "pending").orderBy(F.col("priority").desc(), "scheduled_at", "url").limit(n)


def results_to_frontier(results: DataFrame, high: int = 10, normal: int = 20) -> DataFrame:
    """Result URLs of each query as crawl targets: the first 10 that score above 5 at priority 8
    depth 1, the first 20 others at priority 5 depth 2. First means in result order (row_id)."""
    once = ordered.first_per_key(results, ["query_id", "url"], [F.col("row_id")])
    tiered = once.withColumn("is_high", F.coalesce(F.col("score"), F.lit(0.0)) > 5.0)
    first = ordered.top_k(tiered, ["query_id", "is_high"], [F.col("row_id")], max(high, normal), "_n")
    kept = first.where(F.col("_n") <= F.when(F.col("is_high"), high).otherwise(normal))
    return kept.select("query_id", "url", F.when(F.col("is_high"), 8).otherwise(5).alias("priority"), F.when(F.col("is_high"), 1).otherwise(2).alias("depth"))


def queue_stats(queue: DataFrame, visited: DataFrame) -> DataFrame:
    """Queue rows per status, and visited URLs, as (measure, count) rows."""
    waiting = queue.groupBy(F.concat(F.lit("queue:"), "status").alias("measure")).agg(F.count(F.lit(1)).alias("count"))
    seen = visited.agg(F.count(F.lit(1)).alias("count")).select(F.lit("visited").alias("measure"), "count")
    return waiting.unionByName(seen)
