"""Token ids in a content-addressed store.

Documents are taken in ascending order of their ids. A rolling hash over a document's token ids cuts it into chunks
where its content says so, so that equal passages give equal chunks. A chunk is addressed by the hash of its bytes.
Tasks first write loose packs without what they have already written; the first pack that holds a chunk then owns it, and packs
are rewritten with the chunks they own, so the store holds every chunk once. Recipes list each document's
chunks and the Merkle root over them; a manifest holds the root over all documents. Payloads are never shuffled.

Layout of a store: ``packs/pack-NNNNNNNNNNNN.bin`` (chunks one after another, ids as little-endian integers of the store's
width), ``recipes`` (Parquet: document, place, start, number of ids, chunks, root), ``manifest`` (Parquet: root, number
of documents and of ids per range of documents).
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm import cutting
from weirflow.llm.repeats import mixed
from weirflow.llm.shared import Scratch, filesystem, small_batches

#: Ids the rolling hash looks at; a boundary is one in so many places; ids in a chunk at most.
ROLL, ONE_IN, LONGEST = 16, 256, 4096
#: Bytes in a pack, about; a part of the documents has so many bits of its packs' numbers to itself.
PACK_BYTES, PACKS = 64 << 20, 24
_REF = "array<struct<hash:binary,n:int,pack:bigint,off:bigint>>"


@functools.cache
def _mixed_ids() -> np.ndarray:
    return mixed(np.arange(1 << 16, dtype=np.uint64))


def boundaries(ids: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Ends of the chunks of documents whose ids lie one after another; ``ends`` are the documents' own (one document by default)."""
    ends = np.array([len(ids)]) if ends is None else np.asarray(ends)
    if not len(ids):
        return np.zeros(0, np.int64)
    # the rolling hash: the sum of what the last ids are mixed to, carried on from place to place; a place counts if all of these are its document's
    total = np.cumsum(_mixed_ids()[ids] if ids.dtype.itemsize == 2 else mixed(ids.astype(np.uint64)), dtype=np.uint64)
    rolled = (total[ROLL:] - total[:-ROLL]) * np.uint64(0x9E3779B97F4A7C15)
    cut = np.flatnonzero(rolled < np.uint64((1 << 64) // ONE_IN)) + ROLL + 1
    first = np.r_[0, ends]
    cut = cut[cut > first[np.searchsorted(first, cut - 1, side="right") - 1] + ROLL]
    marks = np.unique(np.r_[cut, ends[np.diff(first) > 0]])
    gap = np.diff(marks, prepend=0)
    more = (gap - 1) // LONGEST
    if not more.any():
        return marks
    extra = np.repeat(marks - gap, more) + LONGEST * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    return np.sort(np.r_[marks, extra])


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    level = leaves or [b""]
    level = [address(b"\0" + x) for x in level]
    while len(level) > 1:
        level = [address(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``start[i], start[i] + 1, ...``, n[i] of them, for all i; each n is 1 at least."""
    step = np.ones(int(n.sum()), np.int32)
    if len(n):
        step[0] = start[0]
        step[np.cumsum(n)[:-1]] = start[1:] - (start[:-1] + n[:-1] - 1)
    return np.cumsum(step, out=step)


class Encoder:
    """Ids of whole texts by a file of the tokenizers library, as one array for a batch of texts, in a store's width.

    Texts are cut into words as the library's byte-level pre-tokenizer does (its classes of characters are asked of the library),
    and the library's model encodes each word once, as long as it is remembered. A text with the string of an added token
    is encoded by the library as a whole, and so is every text if the file has another pre-tokenizer or a normalizer.
    """

    #: Bytes (about) of words and ids that are remembered; then all are forgotten.
    BYTES = 72 << 20
    #: What an entry takes besides its characters and ids.
    ENTRY = 200

    def __init__(self, path: str, dtype: str):
        self.of, self.dtype = tokenizer(path), np.dtype(dtype)
        parts = json.loads(self.of.to_str())
        pre = parts["pre_tokenizer"] or {}
        self.whole = bool(parts["normalizer"]) or (pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space")) != ("ByteLevel", True, False)
        self.added = [t["content"] for t in parts["added_tokens"]]
        self.table = cutting.table_of(cutting.tokenizers_classes())
        self.words: dict[str, bytes] = {}
        self.size = 0
        self.tokenize = self.of.model.tokenize
        self.pack = [struct.Struct(f"<{n}{'H' if self.dtype.itemsize == 2 else 'I'}").pack for n in range(32)]
        # the characters in which byte-level words are written: printable bytes are themselves, the others follow from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.spell = {b: b for b in shown} | {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}

    def _word(self, word: str) -> bytes:
        ids = [t.id for t in self.tokenize(word.encode().decode("latin-1").translate(self.spell))]
        return self.pack[len(ids)](*ids) if len(ids) < len(self.pack) else np.array(ids, self.dtype).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        out = list(map(self.words.get, words))
        if self.size > self.BYTES:
            self.words.clear()
            self.size = 0
        for i, x in enumerate(out):
            if x is None:
                w = words[i]
                x = out[i] = self._word(w)
                if self.size <= self.BYTES:
                    self.words[w] = x
                    self.size += len(w) + len(x) + self.ENTRY
        return out

    def __call__(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, ends)``: the ids of all texts, one after another, each with ``end_id`` behind it, and where each text's end."""
        odd = [i for i, t in enumerate(texts) if self.whole or any(a in t for a in self.added)]
        own = dict(zip(odd, (np.array(e.ids, self.dtype) for e in self.of.encode_batch([texts[i] for i in odd], add_special_tokens=False)), strict=True)) if odd else {}
        found, codes, counts = cutting.cut(["" if i in own else t for i, t in enumerate(texts)], self.table)
        coded = self._words(found.to_pylist())
        flat = np.frombuffer(b"".join(coded), self.dtype)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // self.dtype.itemsize
        start, n = np.cumsum(size) - size, size[codes]
        ids = flat[_runs(start[codes], n)]
        ends = np.r_[0, np.cumsum(n)][np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        if own:
            parts = [own.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True))]
            ids, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        if end_id is not None:
            ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
        return ids, ends


@functools.cache
def _encoder(path: str, dtype: str) -> Encoder:
    """One for all tasks of a worker, so that they share the words met."""
    return Encoder(path, dtype)


def _write(folder: str, name: str):
    """A stream into a file that appears under its name when it is closed by the returned function."""
    fs, base = filesystem(folder)
    fs.create_dir(base, recursive=True)
    part = f"{base}/_{uuid.uuid4().hex}"
    out = fs.open_output_stream(part, compression=None)

    def close():
        out.close()
        fs.move(part, f"{base}/{name}")

    return out, close


def pack_name(k: int) -> str:
    return f"pack-{k:012d}.bin"


@dataclass
class Store:
    """A written store."""

    packs: str
    recipes: DataFrame
    manifest: DataFrame
    dtype: str


def write_store(df: DataFrame, tokenizer_path: str, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> Store:
    """Encode every whole text (NULL: empty), append ``end_id``, and write the store in ascending order of ids.

    A NULL id comes first; rows that repeat an id are in the order of their texts; an empty table writes an empty store; other
    columns are ignored. Very long texts are encoded whole; memory is that of a batch of texts and of a pack's addresses.
    """
    # texts of one batch share what they have of words
    small_batches(df.sparkSession, 2560)
    kind = dict(df.dtypes)[id_col]
    dtype = "<u2" if tokenizer(tokenizer_path).get_vocab_size() <= 1 << 16 else "<u4"
    width = np.dtype(dtype).itemsize
    loose, packs = scratch.folder("loose"), scratch.folder("packs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of = _encoder(tokenizer_path, dtype)
        part, place, out, close = TaskContext.get().partitionId(), 0, None, None
        pack, off, written = part << PACKS, 0, {}
        for b in batches:
            if not b.num_rows:
                continue
            ids, ends = of([t or "" for t in b.column(1).to_pylist()], end_id)
            data, stops = memoryview(ids.tobytes()), boundaries(ids, ends)
            hashes, places, packs_ = [], [], []
            for lo, hi in zip([0, *(stops[:-1] * width).tolist()], (stops * width).tolist(), strict=True):
                h = address(data[lo:hi])
                if h not in written:
                    if out is None or off >= PACK_BYTES:
                        if close:
                            close()
                            pack, off, written = pack + 1, 0, {}
                        out, close = _write(loose, pack_name(pack))
                    written[h] = off
                    out.write(data[lo:hi])
                    off += hi - lo
                hashes.append(h)
                places.append(written[h])
                packs_.append(pack)
            last = np.searchsorted(stops, ends, side="right")
            of_doc = np.r_[0, last]
            refs = pa.StructArray.from_arrays([pa.array(hashes, pa.binary()), pa.array(np.diff(stops, prepend=0).astype(np.int32)), pa.array(packs_, pa.int64()), pa.array(places, pa.int64())], names=["hash", "n", "pack", "off"])
            roots = [merkle(hashes[x:y]) for x, y in zip(of_doc[:-1].tolist(), last.tolist(), strict=True)]
            m = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.full(m, part, np.int32)), pa.array(np.arange(place, place + m, dtype=np.int32)), pa.array(np.diff(ends, prepend=0)), pa.ListArray.from_arrays(pa.array(of_doc.astype(np.int32)), refs), pa.array(roots, pa.binary())],
                names=["id", "part", "place", "n_tokens", "chunks", "root"],
            )
            place += m
        if close:
            close()

    source = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ordered = source.repartitionByRange("id").sortWithinPartitions("id", "text")
    documents = scratch.put(ordered, "documents", run, f"id {kind}, part int, place int, n_tokens bigint, chunks {_REF}, root binary")
    refs = documents.select("part", "place", F.posexplode("chunks").alias("k", "c")).select("part", "place", "k", "c.*")
    owner = refs.groupBy("hash").agg(F.min(F.struct("pack", "off", "n")).alias("o"))
    own = owner.select("o.pack", "o.off", "o.n", "hash").repartition("pack").sortWithinPartitions("pack", "off")
    index = scratch.put(own, "index", _compacted(loose, packs, width), "hash binary, pack bigint, off bigint")
    scratch.drop(loose)
    found = refs.select("part", "place", "k", "hash", "n").join(index, "hash")
    chunks = found.groupBy("part", "place").agg(F.array_sort(F.collect_list(F.struct("k", "hash", "n", "pack", "off"))).alias("chunks"))
    before = _before(documents)
    running = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    starts = documents.select("id", "part", "place", "n_tokens", "root", F.coalesce(running, F.lit(0)).alias("inner")).join(F.broadcast(before), "part")
    recipes = starts.join(chunks, ["part", "place"], "left").select("id", "part", "place", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", F.coalesce("chunks", F.expr("cast(array() as array<struct<k:int,hash:binary,n:int,pack:bigint,off:bigint>>)")).alias("chunks"), "root")
    recipes = scratch.put(recipes.repartitionByRange("part", "place").sortWithinPartitions("part", "place"), "recipes")
    manifest = scratch.put(_manifest(documents), "manifest")
    return Store(packs, recipes, manifest, dtype)


def _before(documents: DataFrame) -> DataFrame:
    """``(part, before)``: ids in all earlier parts; a row per task that wrote, which is what is collected."""
    total, rows = 0, []
    for r in documents.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        rows.append((r["part"], total))
        total += r["n"]
    return documents.sparkSession.createDataFrame(rows, "part int, before bigint")


def _compacted(loose: str, packs: str, width: int):
    """Rewrite packs with the chunks they own; gives the chunks' places. Rows ``(pack, off, n, hash)`` come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(loose)
        pack, source, out, close, at = None, None, None, None, 0
        for b in batches:
            places = []
            of, off, n = (b.column(i).to_numpy() for i in range(3))
            size = n.astype(np.int64) * width
            # chunks next to each other are copied at once
            first = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (off[1:] != off[:-1] + size[:-1])]) if len(of) else []
            for lo, hi in zip(first, [*first[1:], len(of)], strict=True):
                if of[lo] != pack:
                    if close:
                        close()
                        source.close()
                    pack, at = int(of[lo]), 0
                    source = fs.open_input_file(f"{base}/{pack_name(pack)}")
                    out, close = _write(packs, pack_name(pack))
                data = source.read_at(int(size[lo:hi].sum()), int(off[lo]))
                out.write(data)
                places.append(at + np.cumsum(size[lo:hi]) - size[lo:hi])
                at += len(data)
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(0), pa.array(np.concatenate(places) if places else np.zeros(0, np.int64))], names=["hash", "pack", "off"])
        if close:
            close()
            source.close()

    return run


def _manifest(recipes: DataFrame) -> DataFrame:
    """Root, documents and ids of every part, over the documents' roots in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots: list[bytes] = []
        part, tokens = None, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([merkle(roots)], pa.binary()), pa.array([len(roots)], pa.int64()), pa.array([tokens], pa.int64())], names=["part", "root", "n_documents", "n_tokens"])

        for b in batches:
            for p, root, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != part and roots:
                    yield row()
                    roots, tokens = [], 0
                part = p
                roots.append(root)
                tokens += n
        if roots:
            yield row()

    ordered = recipes.select("part", "place", "root", "n_tokens").repartition("part").sortWithinPartitions("part", "place")
    return ordered.select("part", "root", "n_tokens").mapInArrow(run, "part int, root binary, n_documents bigint, n_tokens bigint")


class IntegrityError(ValueError):
    """What the store holds does not match its hashes."""


def verify(store: Store) -> None:
    """Hold the recipes against the manifest: every part's root, documents and ids. A lost, changed or added document raises."""
    told, found = (df.select("part", "root", "n_documents", "n_tokens") for df in (store.manifest, _manifest(store.recipes)))
    wrong = told.exceptAll(found).unionByName(found.exceptAll(told)).select("part").first()
    if wrong:
        raise IntegrityError(f"part {wrong[0]} of the documents is not what the manifest tells")


def read_store(store: Store, digests: bool = False) -> DataFrame:
    """``(id, start, n_tokens, ids)`` of every document, put together from the store's files and verified.

    The recipes are held against the manifest first. Each chunk's bytes are held against their hash and each document against
    its Merkle root as rows are read. With ``digests`` the last column is ids_crc32 instead, of the ids as little-endian
    unsigned 32-bit integers.
    """
    verify(store)
    packs, dtype = store.packs, store.dtype
    width = np.dtype(dtype).itemsize
    kind = dict(store.recipes.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(packs)
        files: OrderedDict[int, object] = OrderedDict()

        def stretch(pack: int, off: int, size: int) -> memoryview:
            if pack not in files:
                if len(files) >= 32:
                    files.popitem(last=False)[1].close()
                files[pack] = fs.open_input_file(f"{base}/{pack_name(pack)}")
            return memoryview(files[pack].read_at(size, off))

        def document(hashes, n, pack, off) -> bytes:
            size, out = n * width, []
            # chunks next to each other in a pack are read at once
            first = np.flatnonzero(np.r_[True, (pack[1:] != pack[:-1]) | (off[1:] != off[:-1] + size[:-1])]).tolist()
            for lo, hi in zip(first, [*first[1:], len(n)], strict=True):
                data, at = stretch(int(pack[lo]), int(off[lo]), int(size[lo:hi].sum())), 0
                for h, m in zip(hashes[lo:hi], size[lo:hi].tolist(), strict=True):
                    if address(data[at : at + m]) != h:
                        raise IntegrityError(f"a chunk in pack {pack[lo]} at {off[lo] + at}")
                    at += m
                out.append(data)
            return b"".join(out)

        for b in batches:
            out, refs = [], b.column(3)
            ends, flat = refs.offsets.to_numpy(), refs.values
            hashes, sizes, of, offs = flat.field(1).to_pylist(), *(flat.field(i).to_numpy() for i in (2, 3, 4))
            for lo, hi, n, root in zip(ends[:-1].tolist(), ends[1:].tolist(), b.column(2).to_pylist(), b.column(4).to_pylist(), strict=True):
                if merkle(hashes[lo:hi]) != root:
                    raise IntegrityError("a document's root")
                ids = np.frombuffer(document(hashes[lo:hi], sizes[lo:hi], of[lo:hi], offs[lo:hi]) if hi > lo else b"", dtype)
                if len(ids) != n:
                    raise IntegrityError("a document's length")
                out.append(zlib.crc32(ids.astype("<u4").tobytes()) if digests else ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.int64() if digests else pa.list_(pa.int32()))], names=["id", "start", "n_tokens", "ids_crc32" if digests else "ids"])

    last = "ids_crc32 bigint" if digests else "ids array<int>"
    return store.recipes.select("id", "start", "n_tokens", "chunks", "root").mapInArrow(run, f"id {kind}, start bigint, n_tokens bigint, {last}")


def op7_tokenstore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store of all documents' ids holds of each."""
    import public_tokenizers as tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    store = write_store(docs, tokenizers.path("byte_bpe_50k.json"), Scratch(spark, "tokenstore"))
    return read_store(store, digests=True).withColumnRenamed("id", "doc_id")
