"""Keyed tables: local ones as Parquet snapshots, remote ones behind functions of the user, and what wraps the latter."""

from __future__ import annotations

import random
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class LocalTable:
    """A keyed table as a snapshot folder with a pointer; an update writes a new snapshot, then moves the pointer.

    Readers see whole snapshots. Keys are unique; a put of several rows of a key keeps the greatest by ``order``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...]):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _fs(self):
        """The file system and the folder in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:/") else f"file://{self.path}")

    def _current(self) -> str | None:
        from pyarrow.fs import FileSelector

        fs, folder = self._fs()
        names = [f.base_name for f in fs.get_file_info(FileSelector(folder, allow_not_found=True))]
        done = sorted(n[len("_at-") :] for n in names if n.startswith("_at-"))
        return done[-1] if done else None

    def read(self) -> DataFrame:
        at = self._current()
        return self.spark.createDataFrame([], self.schema) if at is None else self.spark.read.schema(self.schema).parquet(f"{self.path}/{at}")

    def _swap(self, df: DataFrame) -> None:
        last = self._current()
        version = (int(last.split("-")[0]) if last else 0) + 1
        name = f"{version:012d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}")
        fs, folder = self._fs()
        fs.open_output_stream(f"{folder}/_at-{name}", compression=None).close()

    def _match(self, a: DataFrame, b: DataFrame):
        return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in self.key))

    def get(self, **key: object) -> dict | None:
        row = self.read().where(reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(v) for k, v in key.items()))).first()
        return row.asDict(True) if row else None

    def get_all(self, keys: DataFrame) -> DataFrame:
        table = self.read()
        return table.join(keys, self._match(table, keys), "left_semi")

    def put_all(self, rows: DataFrame, order: str | None = None) -> None:
        """Insert or replace by key."""
        names = self.read().columns
        if order:
            rest = [c for c in rows.columns if c not in self.key]
            rows = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*self.key, "__r.*")
        else:
            rows = rows.dropDuplicates(list(self.key))
        old = self.read()
        self._swap(old.join(rows, self._match(old, rows), "left_anti").unionByName(rows.select(*names)))

    def delete_all(self, keys: DataFrame) -> None:
        old = self.read()
        self._swap(old.join(keys, self._match(old, keys), "left_anti"))

    def update_all(self, updates: DataFrame, defaults: DataFrame | None = None, order: str | None = None) -> None:
        """Set the columns of ``updates`` in rows that are there; others are first made from ``defaults``, or else stay absent.

        Of several updates of a key the greatest by ``order`` counts, or else the greatest by all columns.
        """
        old = self.read()
        rest = [c for c in updates.columns if c not in self.key]
        if rest:
            by = F.struct(*([F.col(order)] if order else []), *(F.col(c) for c in rest))
            updates = updates.groupBy(*self.key).agg(F.max(by).alias("__m")).select(*self.key, *(F.col(f"__m.{c}").alias(c) for c in rest))
        else:
            updates = updates.dropDuplicates(list(self.key))
        if defaults is not None:
            defaults = defaults.dropDuplicates(list(self.key))
        if defaults is not None:
            missing = defaults.join(old, self._match(defaults, old), "left_anti")
            old = old.unionByName(missing, allowMissingColumns=True)
        new = {c: f"__new_{c}" for c in updates.columns}
        u = updates.select(*(F.col(c).alias(n) for c, n in new.items()), F.lit(True).alias("__hit"))
        joined = old.join(u, reduce(lambda x, y: x & y, (old[k].eqNullSafe(u[new[k]]) for k in self.key)), "left")
        self._swap(joined.select(*(F.when(F.col("__hit"), F.col(new[c])).otherwise(old[c]).alias(c) if c in new and c not in self.key else old[c] for c in old.columns)))

    def upsert_batches(self, order: str | None = None) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return lambda df, _: self.put_all(df, order)


class Lookup(Protocol):
    """What a remote table's user gives: values by key, for many keys at once; absent keys are left out."""

    def get_many(self, keys: list) -> dict: ...


@dataclass
class RateLimit:
    """Credits per second, per task."""

    per_second: float
    _free: float = field(default=0.0)
    _at: float = field(default_factory=time.monotonic)

    def take(self, credits: int) -> None:
        now = time.monotonic()
        self._free = min(self.per_second, self._free + (now - self._at) * self.per_second)
        self._at = now
        if credits > self._free:
            time.sleep((credits - self._free) / self.per_second)
            self._free, self._at = 0.0, time.monotonic()
        else:
            self._free -= credits


@dataclass
class Retry:
    """Attempts with a fixed, random or exponential pause between them."""

    attempts: int = 3
    pause: float = 0.05
    kind: str = "exponential"
    longest: float = 5.0
    retriable: Callable[[Exception], bool] = lambda e: True

    def call(self, f: Callable, *a):
        for n in range(self.attempts):
            try:
                return f(*a)
            except Exception as e:
                if n + 1 == self.attempts or not self.retriable(e):
                    raise
                wait = {"fixed": self.pause, "random": random.uniform(0, self.pause), "exponential": self.pause * 2**n}[self.kind]
                time.sleep(min(wait, self.longest))


@dataclass
class Cache:
    """Values by key with a bound and an age; ``missing`` keeps that a key is absent too."""

    size: int = 10_000
    seconds: float = 60.0
    _kept: OrderedDict = field(default_factory=OrderedDict)

    def get(self, key, default=None):
        got = self._kept.get(key)
        if got is None or time.monotonic() - got[0] > self.seconds:
            self._kept.pop(key, None)
            return default
        self._kept.move_to_end(key)
        return got[1]

    def put(self, key, value) -> None:
        self._kept[key] = (time.monotonic(), value)
        self._kept.move_to_end(key)
        while len(self._kept) > self.size:
            self._kept.popitem(last=False)


def lookup_join(df: DataFrame, key: str, open_lookup: Callable[[], Lookup], schema: str, *, how: str = "inner", retry: Retry | None = None, limit: float | None = None, cache: Cache | None = None) -> DataFrame:
    """Join rows with a remote table by one key, in batches: distinct keys, NULL never asked for, cached, limited, retried.

    ``schema`` names the value's fields, which become columns. Filters on ``df`` belong before this call.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup, rate, kept, absent = open_lookup(), RateLimit(limit) if limit else None, cache or Cache(0), object()
        for b in batches:
            keys = [k for k in b[key].drop_duplicates().tolist() if not pd.isna(k)]
            values = {k: v for k in keys if (v := kept.get(k, absent)) is not absent}
            ask = [k for k in keys if k not in values]
            if ask:
                if rate:
                    rate.take(len(ask))
                got = (retry or Retry(1)).call(lookup.get_many, ask)
                for k in ask:
                    values[k] = got.get(k)
                    kept.put(k, values[k])
            found = b[key].map(lambda k, v=values: v.get(k) if not pd.isna(k) else None)
            hit = found.notna()
            out = b if how == "left" else b[hit]
            found = found if how == "left" else found[hit]
            # of type object: other string types can come out in several chunks, which Arrow does not take in a record
            yield out.assign(**{n: pd.Series([v.get(n) if hasattr(v, "get") else None for v in found], index=out.index, dtype=object) for n in names})

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{own}, {schema}")
