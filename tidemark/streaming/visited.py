"""The set of visited URLs as keyed state with a time to live (ST7).

A URL is let through when no earlier visit of it is still remembered, and is then remembered for a fixed span; repeats do not
prolong it. The span runs on event time: a timer at its end clears the URL's state once the watermark has passed, so the
state holds the URLs of the last span and of the lateness allowed, and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TTL_SECONDS = 86_400  # fixed value
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # what keyed state with timers needs


@contextmanager
def state_store(spark: SparkSession):
    """Queries started inside keep their state in ``STATE_STORE``; the session's own choice returns afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STATE_STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def admitted(places: np.ndarray, until: int, ttl: int) -> tuple[list[int], int]:
    """Of ascending times, those let through, given the end of the current span; and the end of the last span.
    Every span is one search, so a crowd of repeats costs no walk."""
    out, at = [], int(np.searchsorted(places, until))
    while at < len(places):
        out.append(int(places[at]))
        until = out[-1] + ttl
        at = int(np.searchsorted(places, until))
    return out, until


def _frame(url: str, times: list[int]) -> pd.DataFrame:
    return pd.DataFrame({"url": pd.Series([url] * len(times), dtype=object), "ts": pd.Series(np.array(times, "datetime64[us]"))})


class VisitedSet(StatefulProcessor):
    """State of one URL: the microsecond at which its span ends."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        held = self.until.get()
        before = held[0] if held is not None else np.iinfo(np.int64).min
        times = np.unique(np.concatenate([part["ts"].to_numpy("datetime64[us]").astype(np.int64) for part in rows]))
        out, until = admitted(times, before, self.ttl)
        if out:
            if held is not None:
                self.handle.deleteTimer(-(-before // 1000))
            self.until.update((until,))
            self.handle.registerTimer(-(-until // 1000))
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.until.clear()
        yield _frame(key[0], [])

    def close(self) -> None:
        pass


def visited_dedup(urls: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """ST7: url, ts of the visits let through: none within ``ttl_seconds`` after an earlier one let through.

    ``urls`` is a stream with url and a watermark on ts (TIMESTAMP). Batches are taken as they come, a batch by time. A row
    that comes late meets the span that is remembered by then, so it is a repeat if it lies before the span's end, and is
    dropped unseen only when it is behind the watermark. Rows without url or ts are left out. Of one URL only the times of
    one batch meet in a task (8 bytes each); the source bounds the batch. The session needs the state store ``STATE_STORE``.
    """
    slim = urls.select("url", "ts").where("url IS NOT NULL AND ts IS NOT NULL")
    return slim.groupBy("url").transformWithStateInPandas(
        statefulProcessor=VisitedSet(ttl_seconds), outputStructType="url STRING, ts TIMESTAMP", outputMode="Append", timeMode="EventTime")
