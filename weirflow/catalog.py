"""Named sources and sinks: schema, how to read, how to write, and of which kind."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY, OP, DELETE = "__key__", "__op__", "DELETE"
STREAM, LOCAL_TABLE, REMOTE_TABLE = "stream", "local_table", "remote_table"
TABLE_SUFFIX = ".$table"


class CatalogError(LookupError):
    """A name the catalogue does not have."""


@dataclass
class Source:
    """A readable or writable name.

    ``key`` names the columns that a row is keyed by; ``version_by`` those that order the versions of a key of a table.
    """

    read: Callable[[SparkSession], DataFrame] | None = None
    write: Callable[[DataFrame], object] | None = None
    schema: StructType | None = None
    kind: str = STREAM
    key: tuple[str, ...] = ()
    version_by: tuple[str, ...] = ()
    optional: frozenset[str] = frozenset()
    is_system: str | None = None


@dataclass
class Catalog:
    """Sources by dotted name. ``name.$table`` reads a source as a local table."""

    entries: dict[str, Source] = field(default_factory=dict)

    def add(self, name: str, source: Source) -> None:
        self.entries[name] = source

    def get(self, name: str) -> Source:
        plain = name.removesuffix(TABLE_SUFFIX)
        if plain not in self.entries:
            raise CatalogError(f"no source or sink {name}")
        return self.entries[plain]

    def kind(self, name: str) -> str:
        return LOCAL_TABLE if name.endswith(TABLE_SUFFIX) and self.get(name).kind != REMOTE_TABLE else self.get(name).kind

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        """Rows of a source with ``__key__`` first, projected onto its schema: absent columns NULL, unknown ones gone."""
        source = self.get(name)
        if source.read is None:
            raise CatalogError(f"{name} cannot be read")
        df = source.read(spark)
        if source.is_system:
            df = df.where(f"NOT coalesce({source.is_system}, false)")
        if self.kind(name) == LOCAL_TABLE and source.version_by:
            df = latest(df, source.key, source.version_by)
        key = F.col(KEY) if KEY in df.columns else _key(source)
        columns = [c for c in df.columns if c != KEY]
        if source.schema is not None:
            have = set(columns)
            own = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema]
        else:
            own = [F.col(f"`{c}`") for c in columns]
        return df.select(key.alias(KEY), *own)


def _key(source: Source):
    if not source.key:
        return F.lit(None).cast("string")
    return F.col(source.key[0]) if len(source.key) == 1 else F.struct(*source.key)


def latest(df: DataFrame, key: tuple[str, ...], by: tuple[str, ...]) -> DataFrame:
    """The last version of every key. One aggregation with map-side combine, not a window, so a hot key is no hot task."""
    if not key:
        raise CatalogError("a table needs a key")
    rest = [c for c in df.columns if c not in key]
    newest = F.max(F.struct(*(F.col(c) for c in by), F.struct(*rest).alias("__row"))) if all(_ordered(df, c) for c in rest) else None
    if newest is not None:
        return df.groupBy(*key).agg(newest.alias("__m")).select(*key, "__m.__row.*")
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in by)))
    return df.withColumn("__r", rank).where("__r = 1").drop("__r")


def _ordered(df: DataFrame, column: str) -> bool:
    return "map" not in df.schema[column].dataType.simpleString()
