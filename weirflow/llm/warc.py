"""WARC archives: writing, and a sequential reader.

One gzip member holds one record. The reader decompresses a stream piece by piece, frames records by their
Content-Length, and verifies block and payload digests, so memory is bounded by one record whatever the
archive's size. Archives lie in the shared folder; a task writes under a temporary name and renames when done,
so a repeated attempt replaces whole files only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.shared import Scratch, filesystem, small_batches, text_column

#: Compression level of the members.
LEVEL = 4
#: Bytes that are read at a time.
PIECE = 1 << 18
#: Payloads of at least so many bytes are written once; later ones revisit them.
LEAST_REVISIT = 0
#: Digests are shared out over so many salts in the join, so that a payload of a third of all rows is no hot key.
SALTS = 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class DigestError(ValueError):
    """A record's bytes do not match its digest or framing."""


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def kind(self) -> str:
        return self.headers.get("warc-type", "")

    def http(self) -> tuple[dict[str, str], bytes]:
        """Headers and payload of a block that is an HTTP response."""
        head, _, payload = self.block.partition(b"\r\n\r\n")
        return _headers(head.split(b"\r\n")[1:]), payload


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def member(kind: str, record_id: str, url: str | None, payload: bytes, payload_digest: str, size: int, refers_to: str | None = None, level: int = LEVEL) -> bytes:
    """One record as a gzip member. A revisit's block is the HTTP head alone, which tells the full payload's size."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}",
    ]
    if url:
        head.append(f"WARC-Target-URI: {escaped(url)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def members(read, piece: int = PIECE) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one after another; ``read(n)`` gives the next bytes."""
    unpack, out, data = zlib.decompressobj(31), [], b""
    started = False
    while True:
        if not data and not (data := read(piece)):
            if started:
                raise DigestError("the archive ends inside a member")
            return
        started = True
        out.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(out)
            unpack, out, started = zlib.decompressobj(31), [], False


def records(read, piece: int = PIECE, verify: bool = True) -> Iterator[Record]:
    """The records of an archive, in order, each framed by its Content-Length and verified."""
    for raw in members(read, piece):
        at = raw.find(b"\r\n\r\n")
        if at < 0 or not raw.startswith(b"WARC/"):
            raise DigestError("a member does not start with a WARC header")
        head = _headers(raw[:at].split(b"\r\n")[1:])
        size = int(head.get("content-length", -1))
        block = raw[at + 4 : at + 4 + size]
        if size < 0 or len(block) != size or raw[at + 4 + size :] != b"\r\n\r\n":
            raise DigestError(f"Content-Length does not frame record {head.get('warc-record-id')}")
        out = Record(head, block)
        if verify:
            if head.get("warc-block-digest", "").removeprefix("sha1:") != digest(block):
                raise DigestError(f"block digest of {head.get('warc-record-id')}")
            if out.kind == "response" and head.get("warc-payload-digest", "").removeprefix("sha1:") != digest(out.http()[1]):
                raise DigestError(f"payload digest of {head.get('warc-record-id')}")
        yield out


def escaped(text: str) -> str:
    """Text for a header: white space, control characters and angle brackets as percent signs with their bytes."""
    return re.sub(r"[\s\x00-\x1f\x7f<>]", lambda m: quote(m[0], safe=""), text)


def _urn(page_id: object) -> str:
    """The name of a record: of a NULL id without a part for it, else with the id, escaped."""
    return "urn:page" if page_id is None else f"urn:page:{quote(str(page_id), safe='')}"


def write_archives(df: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per row; returns ``(path, records)`` of every archive, staged.

    Of rows with equal payloads, those with the least id are responses, the others revisit that id. A NULL
    payload is empty; a NULL id comes after all others. Only payloads that occur under several ids
    take part in the join.
    """
    small_batches(df.sparkSession, 256)
    id_ = F.col(f"`{id_col}`")
    source = df.select(id_.alias("id"), text_column(df, url_col).cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"))
    source = source.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    first = source.where(F.octet_length("html") >= least).groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    first = first.where("n > 1 and first is not null").select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = source.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    joined = salted.join(first, ["sha", "salt"], "left")
    refers = F.when(F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first"))), F.col("first"))
    rows = joined.select(F.col("id").cast("string").alias("id"), "url", F.when(refers.isNull(), F.col("html")).alias("html"), F.octet_length("html").cast("long").alias("size"), "sha", refers.cast("string").alias("refers"))
    folder = scratch.folder("warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, n = None, 0
        fs, base = filesystem(folder)
        name = f"{base}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        part = f"{base}/_{uuid.uuid4().hex}"
        for b in batches:
            for id_, url, html, size, sha, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(part, compression=None)
                kind = "response" if refers is None else "revisit"
                out.write(member(kind, _urn(id_), url, (html or "").encode("utf-8", "surrogatepass"), base64.b32encode(sha).decode(), size, None if refers is None else _urn(refers)))
                n += 1
        if out is not None:
            out.close()
            fs.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([n])], names=["path", "records"])

    return scratch.stage(rows.mapInArrow(run, "path string, records bigint"), "archives")


def read_archives(archives: DataFrame, n_tasks: int | None = None) -> DataFrame:
    """``(record_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)`` of every record.

    Archives are dealt out over tasks; each is read from start to end, verified, and never held whole.
    payload is NULL for revisits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        names = ["record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = filesystem(path)
                rows, size = [], 0
                with fs.open_input_stream(at, compression=None) as f:
                    for r in records(lambda n, f=f: f.read(n)):
                        head, payload = r.http()
                        rows.append((r.headers["warc-record-id"].strip("<>"), r.headers.get("warc-target-uri"), int(head["content-length"]), r.headers["warc-payload-digest"].removeprefix("sha1:"), r.kind, r.headers["warc-refers-to"].strip("<>") if r.kind == "revisit" else None, payload if r.kind == "response" else None))
                        size += len(payload)
                        if len(rows) >= 500 or size > 16 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    schema = "record_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary"
    return archives.select("path").repartition(n_tasks or max(1, archives.count())).mapInArrow(run, schema)


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", scratch: Scratch | None = None) -> DataFrame:
    """Write all rows to archives and read these back: ids, sizes, digests, types, references and payloads.

    Ids of any kind come back as they were, NULL and empty ones too; URLs have their white space escaped. A very long payload is held whole by one
    task, one at a time.

    Rows that repeat both id and payload are all written alike; NULL and empty payloads are zero bytes and are
    equal; an empty table writes no archive; other columns are ignored.
    """
    scratch = scratch or Scratch(df.sparkSession, "warc")
    kind = dict(df.dtypes)[id_col]
    found = read_archives(write_archives(df, scratch, id_col, url_col, html_col))
    own = lambda c: F.expr(f"case when {c} like 'urn:page:%' then url_decode(substring({c}, 10)) end").cast(kind)
    return found.select(own("record_id").alias(id_col), "url", "payload_bytes", "payload_digest", "record_type", own("refers_to").alias("refers_to"), "payload")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold."""
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
