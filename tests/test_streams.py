"""Streams with state over several batches, against walks over the same rows."""

import datetime as dt
import random

import pytest

from tidemark.streaming import jobs, visited

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def stateful(spark):
    with visited.state_store(spark):
        yield spark


def batches(spark, folder, parts, schema):
    """One file per batch, read one file a trigger in order of name."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/part={i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")


def walk(parts, ttl):
    """What a cache with a time to live lets through."""
    until, out = {}, []
    for rows in parts:
        for url, ts in sorted(((u, t) for u, t in rows if u is not None and t is not None)):
            if ts >= until.get(url, dt.datetime.min):
                until[url] = ts + dt.timedelta(seconds=ttl)
                out.append((url, ts))
    return sorted(out)


def test_visited_equals_walk(stateful, tmp_path):
    rng = random.Random(7)
    parts = []
    for day in range(6):
        rows = [(f"u{min(rng.randrange(12), 3 + rng.randrange(9))}", T0 + dt.timedelta(days=day, seconds=rng.randrange(86_400))) for _ in range(300)]
        rows += [(f"u{rng.randrange(9)}", T0 + dt.timedelta(days=day, hours=-rng.randrange(1, 20))) for _ in range(40)]  # late
        parts.append(rows + rows[:20] + [(None, T0), ("u1", None)])
    stream = batches(stateful, tmp_path, parts, "url STRING, ts TIMESTAMP").withWatermark("ts", "3 days")
    jobs.append_to(visited.visited_dedup(stream), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = sorted((r.url, r.ts) for r in stateful.read.parquet(f"{tmp_path}/out").collect())
    assert got == walk(parts, visited.TTL_SECONDS) and len(got) > 50


def test_visited_state_ends_with_its_span(stateful, tmp_path):
    """State of a span that the watermark has passed is gone: later batches hold the new URLs only."""
    parts = [[(f"a{i}", T0) for i in range(50)], [("b", T0 + dt.timedelta(days=3))], [("c", T0 + dt.timedelta(days=6))], [("c", T0 + dt.timedelta(days=6, hours=1))]]
    stream = batches(stateful, tmp_path, parts, "url STRING, ts TIMESTAMP").withWatermark("ts", "1 hour")
    query = jobs.append_to(visited.visited_dedup(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination()
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(rows) >= 50 and rows[-1] < 10
    assert stateful.read.parquet(f"{tmp_path}/out").count() == 52


def test_admitted_searches_spans():
    import numpy as np

    times = np.sort(np.random.default_rng(1).integers(0, 1000, 400))
    out, until = visited.admitted(np.unique(times), 100, 70)
    want, end = [], 100
    for x in np.unique(times).tolist():
        if x >= end:
            want.append(x)
            end = x + 70
    assert (out, until) == (want, end)


def test_file_stream_reads_folders_and_files(spark, tmp_path):
    """A table may be a folder of part files (larger tables are) or one file."""
    rows = spark.range(100).selectExpr("id", "concat('t', id) AS text")
    rows.repartition(4).write.parquet(f"{tmp_path}/in/parts.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/single")
    next((tmp_path / "single").glob("part-*.parquet")).rename(tmp_path / "in" / "one.parquet")
    for name in ("parts", "one"):
        jobs.append_to(jobs.file_stream(spark, f"{tmp_path}/in", name), f"{tmp_path}/{name}", f"{tmp_path}/state-{name}").awaitTermination()
        got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
        assert got == [(i, f"t{i}") for i in range(100)]


@pytest.mark.parametrize("name", ["incremental_index_stream", "trending_stream"])
def test_stream_queries_over_folders(spark, tmp_path, name):
    """The same rows from folders of part files as from single files."""
    import __spark_entry__ as entry

    given = "/root/testdata/sf0.001"
    for table in ("pages", "conversations"):
        spark.read.parquet(f"{given}/{table}.parquet").repartition(3).write.parquet(f"{tmp_path}/{table}.parquet")
    got, want = ([tuple(r) for r in entry.queries()[name](spark, folder).collect()] for folder in (str(tmp_path), given))
    assert sorted(got) == sorted(want) and got
