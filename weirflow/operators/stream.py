"""A fluent stream over a batch or streaming DataFrame: every call adds to the plan, nothing runs before a sink."""

from __future__ import annotations

import asyncio
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stream:
    df: DataFrame

    def map(self, **columns: Column) -> Stream:
        """A row for a row."""
        return Stream(self.df.select(*(c.alias(n) for n, c in columns.items())))

    def map_rows(self, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> Stream:
        """An opaque function over batches of rows; it may drop rows or add some."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from map(function, batches)

        return Stream(self.df.mapInPandas(run, schema))

    def filter(self, condition: Column | str) -> Stream:
        """Rows for which the condition holds; NULL does not hold."""
        return Stream(self.df.where(condition))

    def flat_map(self, values: Column, name: str, keep: tuple[str, ...] = ()) -> Stream:
        """A row for each element of an array; NULL and empty arrays give none."""
        return Stream(self.df.select(*keep, F.explode(values).alias(name)))

    def flat_map_async(self, function: Callable[[dict], Iterable[dict]], schema: str, concurrency: int = 16) -> Stream:
        """Rows from calls that wait for something, so many at a time in a task; results keep the order of the calls.

        ``function`` is a plain function or a coroutine function.
        """

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = (lambda r: asyncio.run(function(r))) if asyncio.iscoroutinefunction(function) else function
            with ThreadPoolExecutor(concurrency) as pool:
                for b in batches:
                    rows = [x for got in pool.map(call, b.to_dict("records")) for x in got]
                    if rows:
                        yield pd.DataFrame(rows)

        return Stream(self.df.mapInPandas(run, schema))

    def partition_by(self, key: Column | str, value: Column | str, partitions: int | None = None) -> Stream:
        """``(key, value)`` dealt out by key. NULL keys go to one partition, as equal keys do."""
        kv = self.df.select((F.col(key) if isinstance(key, str) else key).alias("key"), (F.col(value) if isinstance(value, str) else value).alias("value"))
        return Stream(kv.repartition(partitions, "key") if partitions else kv.repartition("key"))

    def merge(self, *others: Stream) -> Stream:
        return Stream.merge_all([self, *others])

    @staticmethod
    def merge_all(streams: list[Stream]) -> Stream:
        """All rows of all streams, which have the same columns."""
        return Stream(reduce(lambda a, b: a.unionByName(b), (s.df for s in streams)))

    def join_table(self, table: DataFrame, key: str, table_key: str, how: str = "inner") -> Stream:
        """Each row with the table's row of its key. NULL keys match nothing; ``how`` may be left."""
        return Stream(self.df.join(table, self.df[key] == table[table_key], how))

    def join(self, other: Stream, key: str, other_key: str, time: str, ttl: str, how: str = "inner") -> Stream:
        """Pairs ``(left, right)`` of rows with one key whose times are at most ``ttl`` apart."""
        a, b = self.df.select(F.struct("*").alias("left"), F.col(key).alias("lk"), F.col(time).alias("lt")), other.df.select(F.struct("*").alias("right"), F.col(other_key).alias("rk"), F.col(time).alias("rt"))
        if self.df.isStreaming:
            a, b = a.withWatermark("lt", ttl), b.withWatermark("rt", ttl)
        near = F.expr(f"lk = rk AND rt BETWEEN lt - INTERVAL {ttl} AND lt + INTERVAL {ttl}")
        return Stream(a.join(b, near, how).select("left", "right"))

    def tumbling(self, time: str, size: str, *keys: str, slide: str | None = None, late: str = "0 seconds", **folds: Column) -> Stream:
        """Aggregates per window and key; a session time zone of UTC aligns windows to days."""
        df = self.df.withWatermark(time, late) if self.df.isStreaming else self.df
        out = df.groupBy(F.window(time, size, slide).alias("w"), *keys).agg(*(c.alias(n) for n, c in folds.items()))
        return Stream(out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *folds))

    def session(self, time: str, gap: str, *keys: str, late: str = "0 seconds", **folds: Column) -> Stream:
        """Aggregates per key and session, which ends ``gap`` after its last row."""
        df = self.df.withWatermark(time, late) if self.df.isStreaming else self.df
        out = df.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*(c.alias(n) for n, c in folds.items()))
        return Stream(out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *folds))

    def broadcast(self) -> Stream:
        """Marks a side that the caller knows to be small."""
        return Stream(F.broadcast(self.df))

    def send_to(self, write: Callable[[DataFrame], object]) -> Stream:
        """Write and pass on."""
        write(self.df)
        return self

    def sink(self, function: Callable[[DataFrame, int], None], checkpoint: str | None = None):
        """A terminal side effect per batch; a streaming query is returned, started."""
        if not self.df.isStreaming:
            return function(self.df, 0)
        w = self.df.writeStream.foreachBatch(function).trigger(availableNow=True)
        return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
