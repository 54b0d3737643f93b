"""Routing and merging of results from several backends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import clamp, word_set
from tidemark.functions.urls import normalise_url
from tidemark.operators import dedup, ordered

# backends, weights and result quota of a route (fixed values)
SEARX, CRAWLER = "searxng", "go_crawler"
MAX_RESULTS = 20
ROUTES = {
    "community": ([(SEARX, 1.0)], MAX_RESULTS), "both": ([(CRAWLER, 0.6), (SEARX, 0.4)], 15),
    "structured": ([(CRAWLER, 1.0)], MAX_RESULTS), "news": ([(SEARX, 1.0)], 10),
    "hybrid": ([(CRAWLER, 0.5), (SEARX, 0.5)], MAX_RESULTS),
}
DEDUP_JACCARD = 0.9  # fixed value


def route_queries(queries: DataFrame) -> DataFrame:
    """G1: (query, backend, weight, limit) rows by six ordered rules on goal, recency and privacy."""
    goal = F.col("goal")
    name = (F.when(goal == "troubleshooting", "community").when(goal == "comparison", "both")
            .when(goal.isin("purchase", "local_service"), "structured").when(F.col("temporal.recency") == "breaking", "news")
            .when(F.exists("ethical_signals", lambda s: s["dimension"] == "privacy"), "structured").otherwise("hybrid"))
    backends = F.create_map(*[x for n, (bs, limit) in ROUTES.items() for x in (F.lit(n), F.array(*[
        F.struct(F.lit(b).alias("backend"), F.lit(w).alias("weight"), F.lit(int(limit * w)).alias("quota")) for b, w in bs]))])
    return queries.select("query_id", name.alias("route"), F.explode(backends[name]).alias("b")).select("query_id", "route", "b.*")


def apply_quota(results: DataFrame, routes: DataFrame) -> DataFrame:
    """Best results per (query, backend) up to the backend's quota."""
    joined = results.join(routes.select("query_id", F.col("backend").alias("source"), "quota"), ["query_id", "source"])
    order = Window.partitionBy("query_id", "source").orderBy(F.col("score").desc_nulls_last(), F.col("url"))
    return joined.withColumn("position", F.row_number().over(order)).where(F.col("position") <= F.col("quota"))


def merge_results(results: DataFrame) -> DataFrame:
    """One row per query and normalised URL: longest title and content, backends, best and mean score.

    Everything is a partial aggregate. The backend list is a set of a handful of names, so it stays small
    however many copies a URL has.
    """
    keyed = results.withColumn("url", normalise_url(F.col("url")))
    longest = lambda c: F.max_by(F.col(c), F.struct(F.length(c), F.col("row_id") * -1))
    return keyed.groupBy("query_id", "url").agg(
        longest("title").alias("title"), longest("content").alias("content"),
        F.array_sort(F.collect_set("source")).alias("sources"), F.coalesce(F.max("score"), F.lit(0.0)).alias("best_score"),
        F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"), F.count(F.lit(1)).alias("result_count")).withColumn(
        "url_hash", F.md5("url"))


def content_dedup(results: DataFrame, threshold: float = DEDUP_JACCARD) -> DataFrame:
    """Drop a result whose word set resembles that of an earlier kept one of the same query."""
    return dedup.greedy_jaccard(results, "query_id", "row_id", word_set(F.col("content")), threshold)


def normalise_scores(results: DataFrame, method: str = "minmax", score: str = "best_score") -> DataFrame:
    """Scores of each query to 0-1. The statistics are an aggregate joined back, so that a query with
    very many results does not have to fit one task."""
    s = F.col(score)
    stats = results.groupBy("query_id").agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"), F.avg(score).alias("_mean"),
                                            F.stddev_samp(score).alias("_sd"), F.count(F.lit(1)).alias("_n"))
    j = results.join(stats, "query_id")
    sd = F.when(F.col("_n") > 1, F.col("_sd")).otherwise(1.0)
    value = {
        "minmax": F.when(F.col("_hi") > F.col("_lo"), (s - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.when(s > 0, 1.0).otherwise(0.0)),
        "zscore": F.when(sd > 0, clamp((s - F.col("_mean")) / sd)).otherwise(0.0),
        "sigmoid": F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("_mean") - s)),
    }[method]
    return j.withColumn(f"{method}_score", value).drop("_lo", "_hi", "_mean", "_sd", "_n")


def backend_distribution(results: DataFrame, merged: DataFrame) -> DataFrame:
    """Results per backend, and merged rows over raw rows."""
    counts = results.groupBy("source").agg(F.count(F.lit(1)).alias("results"))
    n_merged = merged.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_raw = results.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counts.select("source", "results", (n_merged / n_raw).alias("aggregation_ratio"))
