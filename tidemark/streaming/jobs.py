"""Structured Streaming twins of the event operators (ST1-ST7) with their source and sink.

The transformations take and return streaming frames, so any source (Kafka, files) and any sink can be
put around them. Event time must be a TIMESTAMP column; ``as_event_time`` casts the zone-less one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.text import ratio
from tidemark.operators import filters, topics
from tidemark.sources.payloads import from_envelope, to_envelope

TOPICS = ["intents.extracted", "searches.executed", "results.served", "clicks.recorded"]  # fixed values
LATE = "10 minutes"


def file_stream(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """Stream over one Parquet table of a directory, with the table's own schema. The table is one file or a folder of
    files; a stream takes a single file only by a pattern."""
    path = f"{directory}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def kafka_stream(spark: SparkSession, servers: str, topics_: list[str] | None = None) -> DataFrame:
    """S3 over Kafka (needs the connector jar on the cluster). The checkpoint, not auto-commit, says what was read."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", ",".join(topics_ or TOPICS)).option("startingOffsets", "earliest").load())


def read_events(raw: DataFrame, data_schema: str) -> DataFrame:
    """S3: envelopes to typed rows."""
    return from_envelope(raw, data_schema)


def write_events(df: DataFrame, event_type: str, timestamp: Column) -> DataFrame:
    """Typed rows to envelopes, for a Kafka, text or file sink."""
    return to_envelope(df, event_type, timestamp)


def as_event_time(df: DataFrame, column: str = "ts", late: str = LATE) -> DataFrame:
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def live_metrics_stream(events: DataFrame, window: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """ST1: impressions, clicks, conversions and ctr per sliding window. A shorter slide multiplies the
    state: one hour by five seconds keeps 720 windows per event."""
    kind = F.col("event_type")
    counted = events.groupBy(F.window("ts", window, slide).alias("w")).agg(
        F.count_if(kind == "view").alias("impressions"), F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "purchase").alias("conversions"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "impressions", "clicks", "conversions",
                          F.round(ratio(F.col("clicks"), F.col("impressions"), 100.0), 2).alias("ctr"))


def velocity_stream(clicks: DataFrame, limit: int = 5, window: str = "1 minute", slide: str = "10 seconds") -> DataFrame:
    """ST2: IPs that reach the limit in a sliding window. Counting is partial before the shuffle, so a
    busy IP costs one row per task and window."""
    counted = clicks.groupBy("ip_hash", F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("clicks"))
    return counted.where(F.col("clicks") >= limit).select("ip_hash", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "clicks")


def sanitised_click_stream(clicks: DataFrame) -> DataFrame:
    """ST3."""
    return filters.sanitise_columns(clicks)


def variant_counters(events: DataFrame) -> DataFrame:
    """ST4: counters per variant; run in complete or update mode."""
    kind = F.col("event_type")
    return events.groupBy("variant_id").agg(
        F.count_if(kind == "view").alias("impressions"), F.count_if(kind == "click").alias("clicks"),
        F.count_if(kind == "purchase").alias("conversions"), F.sum(F.when(kind == "purchase", F.col("value"))).alias("revenue"))


def index_batch(path: str):
    """ST5: ``foreachBatch`` function that adds the postings of newly arrived pages. Each batch writes its
    own folder, so a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from tidemark.operators import pages, retrieval

        retrieval.postings(pages.html_to_page(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def hourly_keywords(queries: DataFrame) -> DataFrame:
    """ST6: keyword counts per hour. Decay is applied when the counts are read (``decayed``)."""
    words = queries.select("ts", F.explode(topics.query_keywords(F.col("text"))).alias("keyword"))
    return words.groupBy("keyword", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "keyword", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n")


def decayed(counts: DataFrame, as_of: str, hours: int = 24, k: int = 50) -> DataFrame:
    """ST6 at read: weight of each hour by the age of its start."""
    age = F.timestamp_diff("SECOND", F.col("hour"), F.lit(as_of).cast("timestamp_ntz")) / 3600.0
    live = counts.where(age <= hours)
    scored = live.groupBy("keyword").agg(F.sum(F.col("n") * F.greatest(F.lit(0.1), F.lit(1.0) - age / hours)).alias("score"))
    return scored.withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), "keyword").limit(k)


def visited_dedup(urls: DataFrame) -> DataFrame:
    """ST7: each URL once per day; put a 24 hour watermark on ``ts`` before."""
    return urls.dropDuplicatesWithinWatermark(["url"])


# ---------------------------------------------------------------- running to the end of what is there
def append_to(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    return (df.writeStream.outputMode("append").format(fmt).option("path", path).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def replace_at(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Complete-mode result, rewritten each batch."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return (df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
            .foreachBatch(write).start())


def each_batch(df: DataFrame, fn, checkpoint: str) -> StreamingQuery:
    return df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(fn).start()
