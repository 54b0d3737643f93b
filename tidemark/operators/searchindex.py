"""Full-text index in segments, searched block by block (I1, I2, I3, ST5).

A segment holds the postings of the pages that came together. Pages of a later segment replace earlier ones, tombstones remove
them, and a merge writes what is left as one segment; the reader names the segments that count. Sealed, the
postings of a term lie in blocks of neighbouring pages, each with its highest impact. A search opens the most promising
blocks of a query first; the score of its k-th page then rules out every block whose bound stays below it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vocab
from tidemark.operators import ordered
from tidemark.operators import pages as pg
from tidemark.session import BROADCAST_LIMIT_ROWS, cut_lineage, parts_for, stored

FIELDS = ("title", "content", "meta_description", "url", "phrases")
BOOSTS = {"title": 2.0}  # fixed value; other fields count once
RANGE_PAGES = 256  # pages whose postings share a block
FIRST_RANGES = 4  # blocks of pages opened before the bound is known
SLACK = 1e-6  # scores are rounded to six places
TASK_PAGES = 2048  # pages, and postings, that a task sorts or groups at a time
TASK_POSTINGS = 500_000
POSTINGS = "term STRING, page_id BIGINT, field STRING, length INT, tf BIGINT"


def unicode_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script, without stop words."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), 0), lambda w: F.lower(w))
    return F.filter(words, lambda w: ~w.isin(vocab.INDEX_STOP_WORDS))


def with_phrases(pages: DataFrame) -> DataFrame:
    """Parsed pages with the key phrases of title, content and meta description as a text of their own."""
    text = pg.analysis_text(F.col("title"), F.col("content"), F.col("meta_description"), None)
    return pages.withColumn("phrases", F.array_join(pg.key_phrases(F.lower(text)), " "))


def postings(pages: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per term, page and field, with its count and the field's length in terms.

    Pages are dealt to as many tasks as their number needs, and their words are counted where they are.
    """
    parts = parts_for(pages.sparkSession, pages.count(), TASK_PAGES)
    items = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), unicode_terms(F.col(f)).alias("terms")) for f in fields])).alias("i")
    dealt = pages.select(F.col("page_id").cast("bigint").alias("page_id"), *fields).repartition(parts, "page_id")
    rows = dealt.select("page_id", items).select("page_id", "i.field", F.size("i.terms").alias("length"), F.explode("i.terms").alias("term"))
    return rows.groupBy("term", "page_id", "field", "length").agg(F.count(F.lit(1)).alias("tf"))


# ---------------------------------------------------------------- segments
def write_segment(pages: DataFrame, path: str, segment: int) -> None:
    """Postings of parsed pages as segment number ``segment``. Its own folder is replaced, so a repeated batch adds nothing twice."""
    postings(with_phrases(pages)).write.mode("overwrite").parquet(f"{path}/segment={segment}/postings")
    pages.select(F.col("page_id").cast("bigint").alias("page_id")).distinct().write.mode("overwrite").parquet(f"{path}/segment={segment}/pages")


def write_tombstones(pages: DataFrame, path: str, segment: int) -> None:
    """Remove pages (page_id) from all segments before ``segment``; a later segment may bring them back."""
    pages.select(F.col("page_id").cast("bigint").alias("page_id")).distinct().write.mode("overwrite").parquet(f"{path}/segment={segment}/removed")


def segment_batch(path: str):
    """ST5: ``foreachBatch`` function that writes the pages of a batch as the segment of its number."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_segment(pg.html_to_page(batch), path, batch_id)

    return write


def _part(spark: SparkSession, path: str, name: str, schema: str, segments: list[int]) -> DataFrame:
    """One kind of file of some segments, with the segment's number."""
    if not segments:
        return spark.createDataFrame([], schema + ", segment BIGINT")
    parts = [spark.read.schema(schema).parquet(f"{path}/segment={s}/{name}").withColumn("segment", F.lit(s).cast("bigint")) for s in segments]
    return reduce(DataFrame.unionByName, parts)


def live_postings(spark: SparkSession, path: str, segments: list[int], removals: list[int] = ()) -> DataFrame:
    """Postings that count: each page's from its newest segment, unless a removal of the same or a later number names it.
    ``segments`` and ``removals`` are the numbers of the segments with pages and with tombstones."""
    if len(segments) == 1 and not removals:  # nothing replaces or removes a page
        return _part(spark, path, "postings", POSTINGS, segments).drop("segment")
    newest = _part(spark, path, "pages", "page_id BIGINT", segments).groupBy("page_id").agg(F.max("segment").alias("segment"))
    gone = _part(spark, path, "removed", "page_id BIGINT", list(removals)).groupBy("page_id").agg(F.max("segment").alias("gone"))
    newest = newest.join(gone, "page_id", "left").where(F.col("gone").isNull() | (F.col("gone") < F.col("segment"))).select("page_id", "segment")
    # a table of pages is built in each task; the postings stream by it unsorted
    return _part(spark, path, "postings", POSTINGS, segments).join(newest.hint("shuffle_hash"), ["page_id", "segment"]).select("term", "page_id", "field", "length", "tf")


def merge_segments(spark: SparkSession, path: str, segments: list[int], removals: list[int], into: int) -> list[int]:
    """Write what counts of some segments as segment ``into`` (a new number) and return the segments to read from now on.
    The old files stay until the caller drops them, so readers of the old list are not disturbed and a killed merge harms nothing."""
    live = live_postings(spark, path, segments, removals)
    live.write.mode("overwrite").parquet(f"{path}/segment={into}/postings")
    spark.read.parquet(f"{path}/segment={into}/postings").select("page_id").distinct().write.mode("overwrite").parquet(f"{path}/segment={into}/pages")
    return [into]


# ---------------------------------------------------------------- search
def impacts(postings_: DataFrame) -> DataFrame:
    """Score of each term in each page: BM25 of every field with its boost, summed over fields.

    The postings are read three times: pass stored ones. They move once, to as many tasks as their number needs, where a term's
    document frequencies are counted beside its postings.
    """
    parts = parts_for(postings_.sparkSession, postings_.count(), TASK_POSTINGS)
    stats = postings_.select("page_id", "field", "length").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("avg_length"))
    counts = postings_.repartition(parts, "term").withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("term", "field")))
    k1, b = vocab.BM25_K1, vocab.BM25_B
    idf = F.log(F.lit(1.0) + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (F.lit(1.0) - b + F.lit(b) * F.col("length") / F.col("avg_length")))
    boost = F.coalesce(*[F.when(F.col("field") == f, x) for f, x in BOOSTS.items()], F.lit(1.0))
    # the statistics have one row per field
    return counts.join(F.broadcast(stats), "field").groupBy("term", "page_id").agg(F.sum(idf * norm * boost).alias("impact"))


def seal(impacts_: DataFrame) -> DataFrame:
    """Blocks: term, range (of RANGE_PAGES pages), top (highest impact), pages and impacts side by side."""
    return impacts_.groupBy("term", F.floor(F.col("page_id") / RANGE_PAGES).alias("range")).agg(
        F.max("impact").alias("top"), F.array_sort(F.collect_list(F.struct("page_id", "impact"))).alias("entries"))


def search(queries: DataFrame, blocks: DataFrame, k: int, first: int = FIRST_RANGES) -> DataFrame:
    """The k best pages of every query (column query) that hold any of its terms, ties to the smaller page_id.

    The result is that of the full sum. A query's bound on a range of pages is the sum of its terms' block maxima there.
    Equal queries are searched once. Blocks are read once, for the terms that are asked for.
    """
    queries = cut_lineage(queries)
    terms = queries.select("query").distinct().select("query", F.explode(F.array_distinct(unicode_terms(F.col("query")))).alias("term"))
    # the asked terms go to the blocks while they are few; else a table of them is built in each task. The blocks stream by it unsorted
    words = cut_lineage(terms.select("term").distinct())
    words = words.hint("broadcast" if words.count() <= BROADCAST_LIMIT_ROWS else "shuffle_hash")
    asked = stored(blocks.join(words, "term", "left_semi"))
    bounds = cut_lineage(terms.join(asked.select("term", "range", "top", F.size("entries").alias("n")), "term").groupBy("query", "range").agg(
        F.sum("top").alias("bound"), F.sum("n").alias("n")))
    parts = parts_for(queries.sparkSession, bounds.agg(F.sum("n")).first()[0] or 0, TASK_POSTINGS)

    def opened(ranges: DataFrame) -> DataFrame:
        entries = ranges.select("query", "range").join(terms, "query").join(asked.select("term", "range", "entries"), ["term", "range"])
        dealt = entries.select("query", "range", "entries").repartition(parts, "query", "range")
        scores = dealt.select("query", "range", F.explode("entries").alias("e")).groupBy("query", "range", F.col("e.page_id").alias("page_id")).agg(
            F.round(F.sum("e.impact"), 6).alias("score")).drop("range")
        return ordered.top_k(scores, ["query"], [F.col("score").desc(), F.col("page_id")], k)

    start = ordered.top_k(bounds, ["query"], [F.col("bound").desc(), F.col("range")], first).drop("rank")
    found = cut_lineage(opened(start))
    floors = found.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    left = bounds.join(start.select("query", "range"), ["query", "range"], "left_anti").join(floors, "query", "left")
    rest = opened(left.where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)))
    best = ordered.top_k(found.unionByName(rest).drop("rank"), ["query"], [F.col("score").desc(), F.col("page_id")], k)
    return queries.join(best, "query")
