"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_ROWS = 100_000


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """Session for tests and the bench. A cluster brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and read it back from there.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only a local session that names
    none gets a temporary folder; a cluster without a shared folder is an error, because a folder on one
    machine is lost with that machine.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        sc.setCheckpointDir(shared)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder (same rules as ``cut_lineage``)."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-stream-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Compute a frame once: written as Parquet below the shared checkpoint folder and read from there by every later use."""
    path = shared_folder(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, rows: int, each: int) -> int:
    """Tasks for so many rows: the session's shuffle partitions, or more where a task would get more than ``each`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def bucketed(df: DataFrame, parts: int, *columns: str) -> tuple[DataFrame, str]:
    """A frame stored like ``stored``, dealt to buckets, so that joins by the columns leave it where it is; and its table's name,
    to be dropped after the last use."""
    import uuid

    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, *columns).option("path", shared_folder(df.sparkSession, "bucketed")).saveAsTable(name)
    return df.sparkSession.table(name), name


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """A frame with further columns that are computed a single time per row, however often later expressions and filters name them.

    A plain ``withColumn`` is copied by the optimizer into each later use, and below each filter on it.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
