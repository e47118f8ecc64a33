"""Byte-level BPE by higher-order functions over the distinct words of a corpus.

Tasks cut texts into the words of the tokenizer's pattern, in chunks of some MB, and give each chunk's distinct words as
rows and the order of all its words as numbers. The words are shuffled by themselves, and each distinct word of
the whole corpus is folded once, as bytes: every stretch of it that a token spells is a merge that may come, and a fold over these,
in the order of their ranks and places, joins a stretch if it is two pieces then. The ranks are a literal in the plan, by hash.
Ids go back to the chunks, where each text's ids are put together; decoding puts the pieces of the ids together.

The fold is the ranked merging of pairs, given that every token of a rank file is what merging its own bytes gives with no rank above
its own (``load_ranks`` asserts this): then a merge never makes a pair of lower rank, so merges come in the order of ranks, and a pair of
pieces that spell a token is met when that token's turn comes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm import cutting
from weirflow.llm.shared import Scratch, filesystem, small_batches, trim

#: Characters of text in a chunk (a longer text is a chunk of its own).
CHUNK = 32 << 20
#: Bits for the number of a word in its chunk.
BITS = 28
#: Buckets of the rank literal.
BUCKETS = 1 << 17
#: Words that are put together at a time.
WORDS = 1 << 17


class RankError(ValueError):
    """A rank file whose tokens are not what their own bytes merge to."""


def merged(data: bytes, ranks: dict[bytes, int], most: int) -> list[bytes]:
    """The pieces of ``data`` when pairs are merged by least rank, none above ``most``."""
    pieces = [data[i : i + 1] for i in range(len(data))]
    while len(pieces) > 1:
        rank, i = min((ranks.get(pieces[i] + pieces[i + 1], most + 1), i) for i in range(len(pieces) - 1))
        if rank > most:
            break
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
    return pieces


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: lines of base64 bytes and rank. All single bytes must be there, and every token must be what its bytes merge to."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise RankError("a byte has no rank")
    for token, rank in ranks.items():
        if len(token) > 1 and len(merged(token, ranks, rank)) > 1:
            raise RankError(f"the bytes of token {rank} do not merge to it")
    return ranks


def width_of(ranks: dict[bytes, int]) -> int:
    """Bytes in which an id is packed."""
    return 2 if max(ranks.values()) < 1 << 16 else 4


def _literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as buckets of ``(b, r, h)`` by the hash of b; h is r in hexadecimal."""
    buckets: list[list[dict]] = [[] for _ in range(BUCKETS)]
    digits = 2 * width_of(ranks)
    for b, r in ranks.items():
        buckets[xxhash.xxh64_intdigest(b, 42) & (BUCKETS - 1)].append({"b": base64.b64encode(b).decode(), "r": r, "h": f"{r:0{digits}x}"})
    return F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<b:binary,r:int,h:string>>>")


def _spellings(rank_file: str) -> Column:
    """The bytes of every id."""
    return F.from_json(F.lit(json.dumps([base64.b64encode(x).decode() for x in pieces_of(rank_file)])), "array<binary>")


def _found(piece: str, value: str) -> str:
    """An array of ``value`` (of e, an entry of the literal), empty if the piece is no token."""
    return f"transform(filter(ranks[cast(xxhash64({piece}) & {BUCKETS - 1} as int)], e -> e.b = {piece}), e -> {value})"


def fold_sql(longest: int) -> str:
    """SQL of the packed ids of one word ``w`` (binary, not empty) by the literal ``ranks``, whose longest token has ``longest`` bytes.

    A merge that may come is one long: rank, place and length. The state has a byte 1 where a piece begins, and
    one at the end, else 0.
    """
    merges = f"transform(sequence(2, least({longest}, length(w) - i)), l -> {_found('substring(w, i + 1, l)', "shiftleft(cast(e.r as bigint), 40) | shiftleft(cast(i as bigint), 8) | l")})"
    ordered = f"if(length(w) < 2, cast(array() as array<bigint>), sort_array(flatten(transform(sequence(0, length(w) - 2), i -> flatten({merges})))))"
    at, size = "cast(shiftright(c, 8) & 4294967295 as int)", "cast(c & 255 as int)"
    one = "X'31'"
    two = f"substring(s, {at} + 1, 1) = {one} and substring(s, {at} + {size} + 1, 1) = {one} and length(replace(cast(substring(s, {at} + 2, {size} - 1) as string), '0', '')) = 1"
    step = f"if({two}, overlay(s placing cast(repeat('0', {size} - 1) as binary) from {at} + 2), s)"
    state = f"aggregate({ordered}, cast(repeat('1', length(w) + 1) as binary), (s, c) -> {step})"
    starts = f"transform(array({state}), s -> filter(sequence(0, length(w) - 1), i -> substring(s, i + 1, 1) = {one}))[0]"
    piece = "substring(w, i + 1, coalesce(get(a, k + 1), length(w)) - i)"
    return f"transform(array({starts}), a -> unhex(array_join(flatten(transform(a, (i, k) -> {_found(piece, 'e.h')})), '')))[0]"


def folded(df: DataFrame, word: str, rank_file: str, out: str, when: str = "true") -> DataFrame:
    """``df`` with the ids of the binary column ``word`` where ``when`` holds, packed as big-endian integers of ``width_of`` bytes."""
    ranks = load_ranks(rank_file)
    # the literal stands under one name, so that the plan holds it once
    bound = df.withColumn("__ranks", F.array(_literal(ranks)))
    ids = f"transform(__ranks, ranks -> transform(array({word}), w -> {fold_sql(max(map(len, ranks)))})[0])[0]"
    return bound.withColumn(out, F.expr(f"case when {when} then if(length({word}) = 0, X'', {ids}) end")).drop("__ranks")


def decode(df: DataFrame, rank_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the decoded bytes of an id array as binary: their pieces put together. NULL ids give NULL, and so does an array with a NULL or unknown id."""
    bound = df.withColumn("__pieces", F.array(_spellings(rank_file)))
    # binary arrays have no join, and a fold would copy what it has at every step: pieces are joined as hexadecimal digits
    known = f"forall(`{ids_col}`, i -> i >= 0 and i < size(pieces))"
    return bound.withColumn(out_col, F.expr(f"transform(__pieces, pieces -> if({known}, unhex(array_join(transform(`{ids_col}`, i -> hex(pieces[i])), '')), null))[0]")).drop("__pieces")


def _packed(columns: dict[str, pa.Array]) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict(columns)
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as f:
        return f.read_next_batch()


def planes(numbers: np.ndarray) -> list[bytes]:
    """Numbers from 0 on in bytes of seven bits, the first of all, then the second of those that have one, and so on."""
    out = []
    while len(numbers):
        more = numbers >= 128
        out.append(((numbers & 127) | (more.astype(numbers.dtype) << 7)).astype(np.uint8).tobytes())
        numbers = numbers[more] >> 7
    return out


def numbers_of(planes_: list[bytes]) -> np.ndarray:
    """The numbers that :func:`planes` took."""
    out = np.frombuffer(planes_[0] if planes_ else b"", np.uint8)
    on = np.flatnonzero(out > 127).astype(np.int32)
    out = (out & 127).astype(np.int32)
    for k, data in enumerate(planes_[1:], 1):
        x = np.frombuffer(data, np.uint8)
        out[on] |= (x & 127).astype(np.int32) << (7 * k)
        on = on[x > 127]
    return out


def cut_words(df: DataFrame, pattern: str, scratch: Scratch, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """Staged ``(at, words, payload)``: per chunk a row with what else it has (ids, words per text, words in order), and rows of its distinct words.

    The first has the chunk's number, a multiple of ``2 ** BITS``, as ``at``; the words are counted on from there, ``at`` being the number before a row's
    first word. Words are those of ``pattern``, its classes as tiktoken has them.
    """
    small_batches(df.sparkSession)
    ranges = cutting.tiktoken_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        ids, texts, size, kind = [], [], 0, None

        def done():
            if pattern == cutting.PATTERN:
                words, codes, counts = cutting.cut(texts, cutting.table_of(ranges))
            else:
                words, codes, counts = cutting.cut_by(texts, finder(pattern, ranges))
            if len(words) >= 1 << BITS:
                raise OverflowError("too many distinct words in a text")
            # frequent words get small numbers
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
            number_of = np.empty(len(words), np.int32)
            number_of[order] = np.arange(len(words), dtype=np.int32)
            words, codes = words.take(pa.array(order)), number_of[codes]
            payload = _packed({"ids": pa.array([ids], pa.list_(kind)), "counts": pa.array([counts.astype(np.int32)]), "codes": pa.array([planes(codes)], pa.list_(pa.binary()))})
            parts = [words.slice(at, 1 << 15).cast(pa.binary()) for at in range(0, len(words), 1 << 15)]
            texts.clear()
            del codes, number_of, order, words
            trim()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([None], pa.list_(pa.binary())), pa.array([payload])], names=["at", "words", "payload"])
            for i, part in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array([number + 1 + (i << 15)]), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part), pa.nulls(1, pa.binary())], names=["at", "words", "payload"])

        for b in batches:
            kind = b.schema.field(0).type
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                if ids and size + len(text) > chunk:
                    yield from done()
                    number, ids, texts, size = number + (1 << BITS), [], [], 0
                ids.append(id_)
                texts.append(text)
                size += len(text)
        if ids:
            yield from done()

    source = df.select(f"`{id_col}`", F.col(f"`{text_col}`").cast("string").alias("text"))
    return scratch.stage(source.mapInArrow(run, "at bigint, words array<binary>, payload binary"), "words")


def finder(pattern: str, ranges):
    """A function that lists a text's matches of any pattern, by the ``regex`` module, with letters, numbers and white space as ``ranges`` have them.

    Characters that the module's tables class otherwise are matched as one of the right class that stands for them.
    """
    import regex

    table = cutting.table_of(ranges)
    own = {cutting.LETTER: regex.compile(r"\p{L}"), cutting.NUMBER: regex.compile(r"\p{N}"), cutting.SPACE: regex.compile(r"\s")}
    stand = {cutting.OTHER: "§", cutting.LETTER: "ƺ", cutting.NUMBER: "²", cutting.SPACE: " "}
    text = cutting.all_characters()
    theirs = np.zeros(0x110000, np.uint8)
    for kind, of in own.items():
        theirs[[ord(c) for c in of.findall(text)]] = kind
    swap = {int(c): stand[int(table[c])] for c in np.flatnonzero(theirs != table) if not 0xD800 <= c < 0xE000}
    rare, of = {chr(c) for c in swap}, regex.compile(pattern)

    def find(t: str) -> list[str]:
        if rare.isdisjoint(t):
            return [m.group() for m in of.finditer(t)]
        return [t[m.start() : m.end()] for m in of.finditer(t.translate(swap))]

    return find


def _coded(df: DataFrame, rank_file: str, pattern: str, scratch: Scratch, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """``(at, path, ids)``: each chunk's words by their numbers, with their packed ids, after a row for the chunk itself, whose payload is in the file ``path``. A chunk's rows are together and in order."""
    cut = cut_words(df, pattern, scratch, id_col, text_col, chunk)
    words = cut.where("words is not null").select("at", F.posexplode("words").alias("k", "word")).select((F.col("at") + F.col("k")).alias("at"), "word")
    # a word's rows are next to each other: the first is folded, and what it gives goes on to the others
    same = Window.partitionBy("word").orderBy("at")
    first = folded(words.withColumn("nth", F.row_number().over(same)), "word", rank_file, "ids", "nth = 1")
    on = same.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ids = first.select("at", F.lit(None).cast("string").alias("path"), F.first("ids", ignorenulls=True).over(on).alias("ids"))
    chunks = cut.where("words is null").select("at", F.col("_metadata.file_path").alias("path"), F.lit(None).cast("binary").alias("ids"))
    return ids.unionByName(chunks).repartition(F.shiftright("at", BITS)).sortWithinPartitions("at")


def _payload(path: str, chunk: int) -> pa.RecordBatch:
    import pyarrow.parquet as pq

    fs, at = filesystem(path)
    with fs.open_input_file(at) as f:
        table = pq.read_table(f, columns=["payload"], filters=[("at", "=", chunk)])
    return _unpacked(table.column(0)[0].as_py())


def _texts(batches: Iterator[pa.RecordBatch], width: int):
    """``(ids, counts, codes, ids of the words one after another, how many each has)`` of each chunk."""
    chunk, payload, parts, sizes = None, None, [], []

    def done():
        x = _payload(payload, chunk << BITS)
        flat = np.frombuffer(b"".join(parts), f">u{width}").astype(np.int32)
        return x.column(0).flatten(), x.column(1)[0].values.to_numpy(), numbers_of(x.column(2)[0].as_py()), flat, np.concatenate([np.zeros(0, np.int64), *sizes])

    for b in batches:
        of = b.column(0).to_numpy() >> BITS
        cuts = np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)] if len(of) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if of[lo] != chunk:
                if chunk is not None:
                    yield done()
                    trim()
                chunk, payload, parts, sizes = int(of[lo]), b.column(1)[lo].as_py(), [], []
                lo += 1
            own = b.column(2).slice(lo, hi - lo)
            if len(own):
                at = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
                parts.append(own.buffers()[2][at[0] : at[-1]].to_pybytes() if at[-1] > at[0] else b"")
                sizes.append(np.diff(at) // width)
    if chunk is not None:
        yield done()


def _groups(counts: np.ndarray, most: int = WORDS) -> Iterator[tuple[int, int, int, int]]:
    """Texts that together have about ``most`` words: ``(first text, after the last, first word, after the last)``."""
    ends = np.cumsum(counts, dtype=np.int64)
    at, word = 0, 0
    while at < len(counts):
        last = max(at + 1, int(np.searchsorted(ends, word + most, side="right")))
        yield at, last, word, int(ends[last - 1])
        at, word = last, int(ends[last - 1])


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, scratch: Scratch | None = None) -> DataFrame:
    """``(id_col, ids)`` of every row: the token ids of its whole text, an ``array<int>``.

    NULL and empty texts have no ids; rows that repeat an id are encoded each; an empty table gives an
    empty result; other columns are ignored. A long run without a break is one word and is folded as such.
    """
    scratch = scratch or Scratch(df.sparkSession, "bpe")
    kind, width = dict(df.dtypes)[id_col], width_of(load_ranks(rank_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, counts, codes, flat, size in _texts(batches, width):
            start = np.cumsum(size) - size
            for lo, hi, a, b in _groups(counts):
                c = codes[a:b]
                n = size[c]
                at = np.repeat(start[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(counts[lo:hi])]]
                yield pa.RecordBatch.from_arrays([own.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[at], pa.int32()))], names=[id_col, "ids"])

    return _coded(df, rank_file, pattern, scratch, id_col, text_col, chunk).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def encode_digests(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, scratch: Scratch | None = None) -> DataFrame:
    """As :func:`encode`, but with digests instead of ids: ``(id_col, n_tokens, ids_sha256, decoded_sha256)``.

    ids_sha256 is of the decimal ids, joined by one space, decoded_sha256 of the bytes that the ids decode to.
    """
    scratch = scratch or Scratch(df.sparkSession, "bpe")
    kind, width = dict(df.dtypes)[id_col], width_of(load_ranks(rank_file))

    def joined(parts: pa.Array, counts: np.ndarray, between: bytes) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), parts), between)

    def digests(texts: pa.Array) -> list[str]:
        data, at = memoryview(texts.buffers()[2] or b""), np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1].tolist()
        return [hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(at[:-1], at[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(pieces_of(rank_file), pa.binary())
        names = pa.array([b"%d" % i for i in range(len(pieces))], pa.binary())
        for own, counts, codes, flat, size in _texts(batches, width):
            told, decoded = (joined(x.take(pa.array(flat)), size, between) for x, between in ((names, b" "), (pieces, b"")))
            for lo, hi, a, b in _groups(counts):
                c = pa.array(codes[a:b])
                n = np.add.reduceat(np.r_[size[codes[a:b]], 0], np.minimum(np.r_[0, np.cumsum(counts[lo:hi])[:-1]], b - a)) * (counts[lo:hi] > 0)
                yield pa.RecordBatch.from_arrays(
                    [own.slice(lo, hi - lo), pa.array(n), pa.array(digests(joined(told.take(c), counts[lo:hi], b" "))), pa.array(digests(joined(decoded.take(c), counts[lo:hi], b"")))],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return _coded(df, rank_file, pattern, scratch, id_col, text_col, chunk).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


@functools.cache
def pieces_of(rank_file: str) -> list[bytes]:
    """Bytes by id; ids that no token has are empty."""
    ranks = load_ranks(rank_file)
    out = [b""] * (max(ranks.values()) + 1)
    for b, r in ranks.items():
        out[r] = b
    return out


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    import public_tokenizers as tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
