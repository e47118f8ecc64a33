"""What tests of pipelines need: rows in order or in any order, and a runner over given rows."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from weirflow.catalog import Catalog, Source
from weirflow.engine import Engine


def contains_in_any_order(df: DataFrame, rows: list[tuple]) -> None:
    found, want = Counter(map(tuple, df.collect())), Counter(map(tuple, rows))
    assert found == want, f"missing {want - found}, too many {found - want}"


def contains_in_order(df: DataFrame, rows: list[tuple]) -> None:
    found = [tuple(r) for r in df.collect()]
    assert found == [tuple(r) for r in rows], found


class Runner:
    """Statements over given rows; what they write is kept by sink."""

    def __init__(self, spark: SparkSession):
        self.spark, self.catalog, self.written = spark, Catalog(), {}

    def source(self, name: str, rows: list, schema: str, key: tuple[str, ...] = (), **more) -> Runner:
        self.catalog.add(name, Source(read=lambda s: s.createDataFrame(rows, schema), key=key, **more))
        return self

    def sink(self, name: str, schema=None, **more) -> Runner:
        self.catalog.add(name, Source(write=lambda df: self.written.setdefault(name, []).append(df), schema=schema, **more))
        return self

    def run(self, *statements: str) -> Runner:
        Engine(self.spark, self.catalog).run_all(list(statements))
        return self
