"""Full-text and vector retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing, vocab
from tidemark.operators import cells, ordered
from tidemark.operators import pages as pg

TITLE_BOOST = 2.0  # fixed value
BLOCK_ROWS = 4096


# ---------------------------------------------------------------- index tables
def build_index(pages: DataFrame) -> dict[str, DataFrame]:
    """The index of parsed pages as three tables: docs (intent and quality per page), postings
    (term, page, field, tf) and df (term, field, number of pages). Write them partitioned as needed;
    searches read them like any table."""
    docs = pg.analyse_pages(pages)
    return {"docs": docs, "postings": postings(pages), "df": document_frequency(postings(pages))}


def index_terms(text: Column) -> Column:
    return F.filter(pg.ascii_words(text), lambda w: ~w.isin(vocab.INDEX_STOP_WORDS))


def postings(pages: DataFrame, fields: Sequence[str] = ("title", "content")) -> DataFrame:
    """One row per page, field and term, with its count and the field's length. Stop words are left out,
    which also keeps the longest posting lists out of every join."""
    items = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), index_terms(F.col(f)).alias("terms")) for f in fields])).alias("i")
    rows = pages.select("page_id", items).select("page_id", "i.field", F.size("i.terms").alias("length"), F.explode("i.terms").alias("term"))
    return rows.groupBy("term", "page_id", "field", "length").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("field", "term").agg(F.count(F.lit(1)).alias("df"))


def delete_from_index(table: DataFrame, removed: DataFrame) -> DataFrame:
    """Any index table without some pages."""
    return table.join(removed.select("page_id"), "page_id", "left_anti")


def index_stats(postings_: DataFrame, docs: DataFrame) -> DataFrame:
    """Pages, distinct terms, mean words per page, one row."""
    terms = postings_.agg(F.count_distinct("term").alias("terms"))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.avg("word_count").alias("avg_length")).select(
        "documents", "avg_length", terms.scalar().alias("terms"))


def bm25_impacts(postings_: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Score of each posting, independent of any query: idf times saturated tf, BM25 with title boost."""
    some = postings_.where(F.col("field").isin(list(fields)))
    per_doc = some.select("page_id", "field", "length").distinct()
    stats = per_doc.groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("avg_length"))
    idf = F.log(F.lit(1.0) + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    k1, b = vocab.BM25_K1, vocab.BM25_B
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (F.lit(1.0) - b + F.lit(b) * F.col("length") / F.col("avg_length")))
    boost = F.when(F.col("field") == "title", TITLE_BOOST).otherwise(1.0)
    # one row per field: the planner broadcasts it by its measured size
    return some.join(document_frequency(some), ["field", "term"]).join(stats, "field").select(
        "term", "page_id", (idf * norm * boost).alias("impact"))


def keyword_search(queries: DataFrame, postings_: DataFrame, k: int, fields: Sequence[str] = ("title", "content")) -> DataFrame:
    """Pages that hold any term of the query, best k per query. ``queries`` has query_id and query.

    Equal queries are searched once: terms join per distinct query text, and the k results fan out.
    """
    distinct = queries.select("query").distinct()
    terms = distinct.select("query", F.explode(F.array_distinct(index_terms(F.col("query")))).alias("term"))
    impacts = bm25_impacts(postings_, fields).groupBy("term", "page_id").agg(F.sum("impact").alias("impact"))
    scores = terms.join(impacts, "term").groupBy("query", "page_id").agg(F.sum("impact").alias("score"))
    best = ordered.top_k(scores.withColumn("score", F.round("score", 6)), ["query"], [F.col("score").desc(), F.col("page_id")], k)
    return queries.join(best, "query")


def intent_search(queries: DataFrame, postings_: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """I4: title matches whose page has the query's goal, score scaled by alignment. ``queries`` has the
    intent columns and query; ``docs`` the doc_* columns of M5."""
    from tidemark.operators.matching import alignment

    terms = queries.select("query_id", F.explode(F.array_distinct(index_terms(F.col("query")))).alias("term"))
    hits = terms.join(bm25_impacts(postings_, ("title",)), "term").groupBy("query_id", "page_id").agg(F.sum("impact").alias("text_score"))
    rows = hits.join(queries, "query_id").join(docs, "page_id").where(F.col("goal").isNull() | (F.col("goal") == F.col("doc_goal")))
    scored = alignment(rows).withColumn("score", F.when(F.col("goal").isNull(), F.col("text_score")).otherwise(
        F.col("text_score") * (F.lit(0.5) + F.lit(0.5) * F.col("alignment"))))
    return ordered.top_k(scored.withColumn("score", F.round("score", 6)), ["query_id"], [F.col("score").desc(), F.col("page_id")], k)


def combine_sources(index: DataFrame, web: DataFrame, vector: DataFrame) -> DataFrame:
    """Union of three result lists (query_id, url, score, alignment, vector_score), each score scaled
    by its alignment and vector factors, numbered per query."""
    everything = index.unionByName(web, allowMissingColumns=True).unionByName(vector, allowMissingColumns=True)
    factor = lambda c: F.when(F.col(c).isNotNull(), F.lit(0.5) + F.lit(0.5) * F.col(c)).otherwise(1.0)
    near = F.when(F.col("vector_score") > 0, F.lit(0.5) + F.lit(0.5) * F.col("vector_score")).otherwise(1.0)
    scored = everything.withColumn("score", F.col("score") * factor("alignment") * near)
    return ordered.ranked(scored, ["query_id"], "score", "tie", steps=10)


def topics_from_results(results: DataFrame, k: int = 10) -> DataFrame:
    """Most frequent topics and key phrases over the results of a query (columns topics, key_phrases)."""
    return pg.topic_counts(results, "query_id", F.concat("topics", "key_phrases"), k)


# ---------------------------------------------------------------- vectors
def embed_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """V1: the deterministic embedding of each text. A model-backed Arrow UDF can stand in its place."""
    return docs.withColumn("embedding", hashing.embedding(F.col(text)))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, query_rows: int | None = None, vector_rows: int | None = None) -> DataFrame:
    """V2: exact k nearest vectors by cosine for every query vector.

    Both sides are cut into blocks of bounded size by hash. Each block of queries meets each block of
    vectors in one task, which multiplies matrices a tile at a time and returns only its k best per query; the
    k best of the blocks are merged at the end. No side is broadcast or collected, no pair is written
    out, and a block never grows with the data beyond its bound: the number of blocks does. ``query_rows`` and
    ``vector_rows`` are the row counts, if known; else they are counted. Null embeddings are left out.

    queries: query_id, embedding. vectors: vec_id, embedding.
    """
    queries, vectors = (d.where("embedding IS NOT NULL") for d in (queries, vectors))
    sample = vectors.select(F.size("embedding")).first()
    n_q, n_v = cells.block_counts(query_rows or queries.count(), vector_rows or vectors.count(), sample[0] if sample else 1, cells.tasks_wanted(queries.sparkSession), BLOCK_ROWS)
    left = queries.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("qb"),
                          F.explode(F.sequence(F.lit(0), F.lit(n_v - 1)).cast("array<bigint>")).alias("vb"))
    right = vectors.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(n_v)).alias("vb"),
                           F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<bigint>")).alias("qb"))
    # more tasks than pairs of blocks, so that hardly any task gets several
    left, right = (d.repartition(2 * n_q * n_v, "qb", "vb") for d in (left, right))
    blocks = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(
        lambda a, b: cells.nearest_in_tables(a, b, k), cells.FOUND)
    return ordered.top_k(blocks, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)


def tag_search(docs: DataFrame, goal: str | None = None, use_case: str | None = None, skill_level: str | None = None,
               limit: int = 10, key: str = "page_id") -> DataFrame:
    """V3: pages with some intent tags. All filters run before the limit."""
    if goal is not None:
        docs = docs.where(F.col("primary_goal") == goal)
    if use_case is not None:
        docs = docs.where(F.array_contains("use_cases", use_case))
    if skill_level is not None:
        docs = docs.where(F.col("skill_level") == skill_level)
    return docs.orderBy(key).limit(limit)


def vector_upsert(current: DataFrame, changes: DataFrame) -> DataFrame:
    """V4: replace or add by id; the id of a URL is its md5. The newest change of an id wins."""
    newest = ordered.first_per_key(changes.withColumn("vector_id", F.md5("url")), ["vector_id"], [F.col("version")], largest=True)
    kept = current.withColumn("vector_id", F.md5("url")).join(newest.select("vector_id"), "vector_id", "left_anti")
    return kept.unionByName(newest)


def vector_delete(current: DataFrame, urls: DataFrame) -> DataFrame:
    """V4."""
    return current.join(urls.select("url"), "url", "left_anti")
