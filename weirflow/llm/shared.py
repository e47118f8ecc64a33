"""What the corpus operators share: the cluster's shared folder, staging and file access from workers."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a URI.

    It is what ``spark.checkpoint.dir`` names. Only where that is unset and the driver is the only machine (tests) a temporary folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weirflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found if re.match(r"\w+:/", found) else f"file://{found}"


class Scratch:
    """A folder of staged tables inside the shared folder.

    Staged tables cut lineage: they survive lost executors, and what follows reads them again. Those that nothing lazy reads any more
    are dropped by their name, or all at once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._made: list[tuple[str, str]] = []

    def folder(self, name: str) -> str:
        self._made.append((name, f"{self.path}/{name}-{len(self._made) + 1}"))
        return self._made[-1][1]

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back."""
        path = self.folder(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put(self, df: DataFrame, name: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, schema: str | None = None) -> DataFrame:
        """Write ``df``, or what ``run`` gives of its batches, as Parquet by the workers themselves and read it back.

        What a worker makes does not go back through the JVM. On a local file system Hadoop starts processes (``chmod``) for every file
        that it writes, each of which has the whole memory of an executor's JVM for a moment; here none are started.
        """
        path = self.folder(name)
        fs, at = filesystem(path)
        fs.create_dir(at, recursive=True)
        carry_out(df.mapInArrow(_writing(path, run), "rows bigint"))
        return self.spark.read.schema(schema or df.schema).parquet(path)

    def drop(self, path: str) -> None:
        from pyarrow.fs import FileType

        fs, at = filesystem(path)
        if fs.get_file_info(at).type == FileType.Directory:
            fs.delete_dir(at)

    def drop_named(self, *names: str, but_last: int = 0) -> None:
        """Drop the staged tables of some names, all but the last so many of each."""
        for name in names:
            paths = [p for n, p in self._made if n == name]
            for path in paths[: len(paths) - but_last]:
                self.drop(path)
                self._made = [(n, "" if p == path else p) if n == name else (n, p) for n, p in self._made]
            self._made = [(n, p) if p else ("", "") for n, p in self._made]

    def drop_all(self) -> None:
        self.drop(self.path)


def carry_out(df: DataFrame) -> None:
    """Let the tasks of ``df`` run, whose rows are of no use; the shuffle files of that go from the executors' disks at its end."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        if before is None:
            conf.unset(key)
        else:
            conf.set(key, before)


def forget(spark: SparkSession) -> None:
    """Let the driver find what it no longer refers to, so that the shuffle files of that go from the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` of a URI, on a worker or the driver."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


#: Bytes in a row group, about.
_GROUP = 8 << 20


class ParquetFile:
    """A Parquet file that appears under its name when it is closed, in place of one that an earlier attempt of the task wrote."""

    def __init__(self, folder: str, name: str):
        self.fs, self.base = filesystem(folder)
        self.name, self.part = f"{self.base}/{name}", f"{self.base}/_{uuid.uuid4().hex}"
        self.out, self.held, self.size = None, [], 0

    def write(self, batch: pa.RecordBatch) -> None:
        if batch.num_rows:
            self.held.append(batch)
            self.size += batch.nbytes
            if self.size >= _GROUP:
                self._flush()

    def _flush(self) -> None:
        import pyarrow.parquet as pq

        table = pa.Table.from_batches(self.held)
        if self.out is None:
            self.fs.create_dir(self.base, recursive=True)
            self.stream = self.fs.open_output_stream(self.part, compression=None)
            self.out = pq.ParquetWriter(self.stream, table.schema, compression="zstd", compression_level=3, use_dictionary=False, write_statistics=False)
        self.out.write_table(table, row_group_size=table.num_rows)
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        if self.out is not None:
            self.out.close()
            self.stream.close()
            self.fs.move(self.part, self.name)


def part_name() -> str:
    """The name of a task's file."""
    from pyspark import TaskContext

    return f"part-{TaskContext.get().partitionId():05d}.parquet"


def _writing(folder: str, run: Callable | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = ParquetFile(folder, part_name()), 0
        for b in run(batches) if run else batches:
            out.write(b)
            rows += b.num_rows
        out.close()
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    return write


def trim() -> None:
    """Give memory that a worker has freed back to the machine, where the C library can."""
    import ctypes

    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows and bytes in an Arrow batch, so that batches of very long texts fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def words_of(text: bytes) -> list[bytes]:
    """Words of ``[^\\x20\\x09-\\x0D]+``; ``bytes.split`` splits at exactly these characters."""
    return text.split()


def text_column(df: DataFrame, name: str, default: str | None = None):
    """A column by its name, taken literally; absent columns are NULL."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(default)
