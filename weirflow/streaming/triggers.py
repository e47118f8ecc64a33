"""Windows with early triggers, and keyed timers, as stateful processors on the RocksDB state store."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, window_start timestamp, count bigint, total double, firing string"


@dataclass(frozen=True)
class Trigger:
    """When an open window gives an early pane: after so many rows, after a time since its first or its last row.

    The first condition that holds fires; ``repeat`` re-arms it.
    """

    count: int = 0
    since_first_ms: int = 0
    since_last_ms: int = 0
    repeat: bool = False


class _Panes(StatefulProcessor):
    """Count and sum per key and tumbling window of event time."""

    def __init__(self, size_ms: int, trigger: Trigger, discarding: bool):
        self.size, self.trigger, self.discarding = size_ms, trigger, discarding

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # window start: rows and sum of the pane, rows since the last early firing, whether it has fired, timer
        self.open = handle.getMapState("open", "start bigint", "n bigint, total double, since bigint, fired boolean, timer bigint")

    def _pane(self, key, start: int, n: int, total: float, firing: str) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "window_start": [pd.Timestamp(start, unit="ms")], "count": [n], "total": [total], "firing": [firing]})

    def _early(self, key, start: int, n: int, total: float) -> tuple[pd.DataFrame, int, float]:
        out = self._pane(key, start, n, total, "EARLY")
        return (out, 0, 0.0) if self.discarding else (out, n, total)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t = self.trigger
        for b in rows:
            for at, value in zip(b["ts"], b["value"], strict=True):
                ms = int(at.timestamp() * 1000)
                start = ms - ms % self.size
                if self.open.containsKey((start,)):
                    n, total, since, fired, timer = self.open.getValue((start,))
                else:
                    n, total, since, fired, timer = 0, 0.0, 0, False, 0
                    self.handle.registerTimer(start + self.size)
                    if t.since_first_ms:
                        timer = min(ms + t.since_first_ms, start + self.size)
                        self.handle.registerTimer(timer)
                if t.since_last_ms:
                    if timer and timer != start + self.size:
                        self.handle.deleteTimer(timer)
                    timer = min(ms + t.since_last_ms, start + self.size)
                    self.handle.registerTimer(timer)
                n, total, since = n + 1, total + float(value), since + 1
                if t.count and since >= t.count and (t.repeat or not fired):
                    out, n, total = self._early(key, start, n, total)
                    fired, since = True, 0
                    yield out
                self.open.updateValue((start,), (n, total, since, fired, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        for (start,), (n, total, since, fired, timer) in list(self.open.iterator()):
            if at >= start + self.size:
                self.open.removeKey((start,))
                if n:
                    yield self._pane(key, start, n, total, "DEFAULT")
            elif timer == at and (self.trigger.repeat or not fired):
                out, n, total = self._early(key, start, n, total)
                self.open.updateValue((start,), (n, total, 0, True, 0))
                yield out

    def close(self) -> None:
        pass


def tumbling_with_trigger(df: DataFrame, key: str, time: str, value: str, size_ms: int, trigger: Trigger, *, discarding: bool = False, late: str = "0 seconds") -> DataFrame:
    """Panes of keyed tumbling windows with early firings: ``(key, window_start, count, total, firing)``.

    Accumulating panes hold all rows of the window so far, discarding ones those since the last firing. Late
    triggers never fire: rows behind the watermark are dropped. Needs the RocksDB state store.
    """
    rows = df.select(F.col(key).cast("string").alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("value")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Panes(size_ms, trigger, discarding), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
