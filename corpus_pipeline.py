"""A corpus pipeline of five stages over ``documents``: quality, near-duplicates, decontamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next stage's
documents. Rows are told apart by doc_id and text; all but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, pii, quality, simhash, winnow
from tidemark.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHORT = 1 << 18  # rows of a list of decisions (id, hash, count) that is sent to all documents, 6 MB; a longer one is joined by a shuffle


def _rows(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_hash", F.xxhash64("text"))


def _same(docs: DataFrame, others: DataFrame):
    return docs["doc_id"].eqNullSafe(others["id"]) & (docs["_hash"] == others["hash"])


def _decided(rows: DataFrame, name: str) -> DataFrame:
    """A list of decisions, written once, and sent to the documents if its count shows it to be short."""
    rows = written(rows, name)
    return F.broadcast(rows) if rows.count() <= SHORT else rows


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects (score below 0.7). Null and empty texts are scored like any other."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    good = scored.filter("predicted = 1").select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))  # most rows: joined by a shuffle
    docs = _rows(docs)
    return docs.join(good, _same(docs, good), "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of texts 0.8 alike or more in distinct five-word shingles; of repeated rows, one.
    Texts meet by the links of their fingerprints (op3), then by an exact filter that finds the pairs these leave apart.
    Texts without words form one group. Of a group without any doc_id, every different text stays."""
    groups = simhash.near_copies(docs)
    first = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.count("*").alias("rows"))
    docs, first = _rows(docs), _decided(first, "near-first")
    kept = docs.join(first, _same(docs, first))
    # only rows that are there more than once meet to become one
    again = kept.filter("rows > 1").dropDuplicates(["doc_id", "_hash"])
    return kept.filter("rows = 1").select(*COLUMNS).unionAll(again.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold any window of a benchmark item. Texts without words stay."""
    hit = winnow.contamination(docs, table(spark, sf_dir, "benchmark")).filter("contaminated")
    hit = _decided(hit.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")), "contaminated")
    docs = _rows(docs)
    return docs.join(hit, _same(docs, hit), "left_anti").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span of personal data by its kind in brackets. A null text stays null."""
    found = pii.find_personal_data(docs.select(*COLUMNS))
    return found.withColumn("text", pii.redacted()).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with copies (1 to 3) and taken, the words they make; documents of no copy go. Repeated rows
    become one row with the sum of their copies."""
    mixed = mixing.mix_sources(docs).groupBy("row_hash").agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken")).filter("copies > 0")
    docs = docs.select(*COLUMNS).withColumn("row_hash", F.xxhash64("doc_id", "text")).dropDuplicates(["row_hash"])
    return docs.join(mixed, "row_hash").select(*COLUMNS, "copies", "taken")


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("decontamination", decontaminate),
          ("personal_data", mask_personal_data), ("mixing", mix)]
ORACLE_SQL = None  # the classifier, the near copies and the mixing have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
