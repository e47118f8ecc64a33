"""Readers and writers of external systems, and what is there of them in this installation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConnectorUnavailable(RuntimeError):
    """The connector's package is not on Spark's class path."""


#: Formats that need a package, with the class that tells whether it is there (fixed values).
PACKAGES = {"kafka": "org.apache.spark.sql.kafka010.KafkaSourceProvider", "avro": "org.apache.spark.sql.avro.AvroFileFormat", "kinesis": "org.apache.spark.sql.connector.kinesis.KinesisV2TableProvider", "elasticsearch": "org.elasticsearch.spark.sql.DefaultSource15"}


def available(spark: SparkSession, kind: str) -> bool:
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(PACKAGES[kind])
    except Exception:
        return False
    return True


def _need(spark: SparkSession, kind: str) -> None:
    if not available(spark, kind):
        raise ConnectorUnavailable(f"{kind}: {PACKAGES[kind]} is not on the class path")


def startpoint(kind: str, value: object = None) -> dict[str, str]:
    """Options of a start position: oldest, upcoming, a specific offset map, or a timestamp."""
    return {"oldest": {"startingOffsets": "earliest"}, "upcoming": {"startingOffsets": "latest"}, "specific": {"startingOffsets": str(value)}, "timestamp": {"startingTimestamp": str(value)}}[kind]


def kafka_read(spark: SparkSession, servers: str, topic: str, start: dict[str, str] | None = None, streaming: bool = True, **options: str) -> DataFrame:
    _need(spark, "kafka")
    r = (spark.readStream if streaming else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return r.options(**(start or startpoint("oldest")), **options).load()


def kafka_write(df: DataFrame, servers: str, topic: str, key: str = "__key__"):
    """Rows as JSON, keyed; a tombstone has a NULL value."""
    _need(df.sparkSession, "kafka")
    rest = [c for c in df.columns if c not in (key, "__op__")]
    value = F.to_json(F.struct(*rest)) if rest else F.lit(None).cast("string")
    return df.select(F.col(key).cast("string").alias("key"), value.alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def directory_read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, *, streaming: bool = False, only: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A bounded directory scan, or a stream of the files that come; ``only`` is a pattern of file names."""
    if kind == "avro":
        _need(spark, "avro")
    r = spark.readStream if streaming else spark.read
    r = r.format(kind)
    r = r.schema(schema) if schema else r
    r = r.option("pathGlobFilter", only) if only else r
    r = r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r
    return r.load(path)


def directory_write(df: DataFrame, path: str, kind: str = "parquet", *, date_column: str | None = None, rows_per_file: int | None = None, compression: str | None = None) -> None:
    """Files in folders by date, rolled at a number of rows."""
    if kind == "avro":
        _need(df.sparkSession, "avro")
    out = df.withColumn("date", F.to_date(date_column)) if date_column else df
    w = out.write.format(kind).mode("append")
    w = w.partitionBy("date") if date_column else w
    w = w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w
    w = w.option("compression", compression) if compression else w
    w.save(path)


def text_lines(spark: SparkSession, folder: str, streaming: bool = False) -> DataFrame:
    """Lines of text files."""
    return (spark.readStream if streaming else spark.read).text(folder)


def console_write(df: DataFrame, show: Callable[[str], None] = print, rows: int = 100) -> None:
    """The first rows as JSON."""
    for r in df.limit(rows).toJSON().take(rows):
        show(r)


def memory_read(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A bounded source of given rows."""
    return spark.createDataFrame(rows, schema)


def jdbc_read(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A remote table that can be enumerated, read in key ranges."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions), **options).load()
