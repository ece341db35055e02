"""Notices about growing outputs: a keyed stream with the last size as state and a timer for the periodic one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .logs import drained

GREW, PERIODIC = "new output", "periodic"
NOTICES = "key string, notice string, ms long, size long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watch(StatefulProcessor):
    """One notice for a key and batch in which its size passes all before, and one for each period since the key's first time, up to the watermark. Rows may come in any order."""

    def __init__(self, every_ms: int) -> None:
        self.every_ms = every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.most = handle.getValueState("most", "size long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N803
        first, size = None, -1
        for part in rows:
            first = min(int(part["ms"].min()), first) if first is not None else int(part["ms"].min())
            size = max(size, int(part["size"].max()))
        last = self.most.get()[0] if self.most.exists() else None
        if last is None:
            self.handle.registerTimer(first + self.every_ms)
        if last is None or size > last:
            self.most.update((max(size, 0),))
        if size > (last or 0):
            yield pd.DataFrame({"key": [key[0]], "notice": [GREW], "ms": [None], "size": [size]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        due = list(range(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() + 1, self.every_ms))
        self.handle.registerTimer(due[-1] + self.every_ms)
        size = self.most.get()[0]
        yield pd.DataFrame({"key": [key[0]] * len(due), "notice": [PERIODIC] * len(due), "ms": due, "size": [size] * len(due)})

    def close(self) -> None:
        pass


def notices(outputs: DataFrame, every_ms: int = 12 * 3600 * 1000, late: str = "10 minutes") -> DataFrame:
    """key, notice, at (null for growth), size of a stream of outputs (key, ts, size)."""
    rows = outputs.where("key IS NOT NULL AND ts IS NOT NULL").select(F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("t"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    timed = rows.withColumn("ms", F.unix_millis("t")).withWatermark("t", late)
    found = timed.groupBy("key").transformWithStateInPandas(Watch(every_ms), NOTICES, "Append", "EventTime")
    return found.select("key", "notice", F.timestamp_millis("ms").alias("at"), "size")


def watched(outputs: DataFrame, out: str | None = None, **options) -> DataFrame:
    """The notices about all that is there, through a state store that keeps timers."""
    conf = outputs.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        return drained(notices(outputs, **options), out=out)
    finally:
        conf.set(PROVIDER, before)
