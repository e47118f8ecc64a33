"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document: each task turns some MB of texts into a segment that maps every word
to its ascending positions. A segment is one row of a staged Parquet table, so a frequent word never gathers
in one task and building needs no shuffle. A search sends the benchmark's windows to every segment in blocks
of a bounded size; per segment a window's lists are intersected from its rarest word on, each list shifted by
the word's offset.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.shared import Scratch, small_batches

WINDOW = 13
#: Bytes of text in a segment (a longer text is a segment of its own).
SEGMENT_BYTES = 8 << 20
#: Bytes of benchmark text sent to the segments at a time. Larger benchmarks are searched in several blocks.
BLOCK_BYTES = 16 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none for NULL."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Segment:
    """Positional index of some documents; positions run on through all of them."""

    def __init__(self, words: list[bytes], starts: np.ndarray, postings: np.ndarray, bases: np.ndarray, ends: np.ndarray):
        self.term = {w: i for i, w in enumerate(words)}
        self.starts, self.postings, self.bases, self.ends = starts, postings, bases, ends

    def list_of(self, term: int) -> np.ndarray:
        return self.postings[self.starts[term] : self.starts[term + 1]]

    def phrase(self, ids: list[int], slop: int = 0) -> np.ndarray:
        """Starts of the occurrences of the words ``ids`` in a row, none across documents.

        With a slop, every word may lie up to so many positions off its place.
        """
        if not ids or min(ids) < 0:
            return self.postings[:0]
        order = sorted(range(len(ids)), key=lambda i: self.starts[ids[i] + 1] - self.starts[ids[i]])
        at = self.list_of(ids[order[0]]) - order[0]
        # every word must be in the document of the rarest one
        doc = np.searchsorted(self.bases, at + order[0], side="right") - 1
        low, high = self.bases[doc], self.ends[doc]
        inside = (at >= low) & (at + len(ids) <= high)
        at, low, high = at[inside], low[inside], high[inside]
        for i in order[1:]:
            if not len(at):
                break
            have, want = self.list_of(ids[i]), at + i
            k = np.searchsorted(have, want)
            if slop:
                near = np.zeros(len(at), bool)
                for place in (have[np.minimum(k, len(have) - 1)], have[np.maximum(k, 1) - 1]):
                    near |= (np.abs(place - want) <= slop) & (place >= low) & (place < high)
            else:
                near = have[np.minimum(k, len(have) - 1)] == want
            at, low, high = at[near], low[near], high[near]
        return at


def _segments(texts: Iterable[tuple[object, str | None]]) -> Iterator[tuple[list, list[int], bytes, np.ndarray, np.ndarray]]:
    """Per segment: ids, words per document, vocabulary, list lengths, postings as gaps."""
    number: dict[bytes, int] = {}
    ids: list = []
    counts: list[int] = []
    stream: list[np.ndarray] = []
    size = 0

    def done():
        tokens = np.concatenate(stream) if stream else np.zeros(0, np.int32)
        order = np.argsort(tokens, kind="stable").astype(np.int32)
        lengths = np.bincount(tokens, minlength=len(number)).astype(np.int32)
        gaps = np.diff(order, prepend=np.int32(0)).astype(np.int32)
        return ids, counts, b" ".join(number), lengths, gaps

    for id_, text in texts:
        words = terms(text)
        if ids and size + len(text or "") > SEGMENT_BYTES:
            yield done()
            number, ids, counts, stream, size = {}, [], [], [], 0
        ids.append(id_)
        counts.append(len(words))
        stream.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        size += len(text or "")
    if ids:
        yield done()


def build_index(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The staged index of ``df``: a row per segment, all words and positions of its documents."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None

        def rows():
            nonlocal kept
            for b in batches:
                kept = b.schema.field(0).type
                yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

        for ids, counts, vocabulary, lengths, gaps in _segments(rows()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(kept)), pa.array([counts], pa.list_(pa.int32())), pa.array([vocabulary], pa.binary()), pa.array([lengths.tobytes()], pa.binary()), pa.array([gaps.tobytes()], pa.binary())],
                names=["ids", "n_words", "vocabulary", "lengths", "gaps"],
            )

    source = df.select(f"`{id_col}`", F.col(f"`{text_col}`").cast("string").alias("text"))
    built = source.mapInArrow(run, f"ids array<{kind}>, n_words array<int>, vocabulary binary, lengths binary, gaps binary")
    return scratch.stage(built.withColumn("segment", F.expr("uuid()")), "segments")


def _opened(b: pa.RecordBatch, i: int) -> tuple[list, np.ndarray, Segment]:
    ids = b.column(0)[i].as_py()
    counts = np.array(b.column(1)[i].as_py(), np.int64)
    words = b.column(2)[i].as_py().split()
    lengths = np.frombuffer(b.column(3)[i].as_py(), np.int32).astype(np.int64)
    postings = np.cumsum(np.frombuffer(b.column(4)[i].as_py(), np.int32), dtype=np.int64)
    bases = np.cumsum(counts) - counts
    return ids, counts, Segment(words, np.r_[0, np.cumsum(lengths)], postings, bases, bases + counts)


def matches(index: DataFrame, items: list[tuple[object, str | None]], window: int = WINDOW, slop: int = 0) -> DataFrame:
    """``(segment, ord, id, n_words, spans)`` for every indexed document.

    spans are ``(item, start, end)``: maximal runs of word positions of the document that windows of the item
    cover, item its place in ``items``. With a slop the spans are those of proximity matches. Items
    without words have no window; shorter items are one window.
    """
    kind = dict(index.dtypes)["ids"][6:-1]
    queries = [(k, terms(t)) for k, (_, t) in enumerate(items)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield one(b, i)

    def one(b: pa.RecordBatch, i: int) -> pa.RecordBatch:
        ids, counts, seg = _opened(b, i)
        spans: list[list[dict]] = [[] for _ in ids]
        for k, words in queries:
            local = [seg.term.get(w, -1) for w in words]
            n = min(window, len(local))
            found = [at for j in range(len(local) - n + 1 if n else 0) if len(at := seg.phrase(local[j : j + n], slop))]
            if not found:
                continue
            at = np.unique(np.concatenate(found))
            doc = np.searchsorted(seg.bases, at, side="right") - 1
            opens = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + n)]
            first = np.flatnonzero(opens)
            last = np.r_[first[1:], len(at)] - 1
            for d, s, e in zip(doc[first].tolist(), at[first].tolist(), (at[last] + n).tolist(), strict=True):
                spans[d].append({"item": k, "start": int(s - seg.bases[d]), "end": int(e - seg.bases[d])})
        m = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([b.column(5)[i].as_py()] * m), pa.array(np.arange(m, dtype=np.int32)), pa.array(ids, b.schema.field(0).type.value_type), pa.array(counts), pa.array(spans, pa.list_(pa.struct([("item", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])))],
            names=["segment", "ord", "id", "n_words", "spans"],
        )

    return index.select("ids", "n_words", "vocabulary", "lengths", "gaps", "segment").mapInArrow(run, f"segment string, ord int, id {kind}, n_words bigint, spans array<struct<item:int,start:bigint,end:bigint>>")


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of a bounded size, one after another."""
    block, size = [], 0
    for row in benchmark.select(f"`{id_col}`", F.col(f"`{text_col}`").cast("string")).toLocalIterator():
        if block and size + len(row[1] or "") > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1] or "") + 16
    yield block


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = 0, scratch: Scratch | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``df``: ``(id_col, n_words, n_hit, n_items, items, contaminated)``.

    A word is hit if it lies in an occurrence of a window of ``window`` words of an item. contaminated: some
    word is hit and 20 * n_hit >= n_words. items: ids of the items found, as sorted distinct strings (a NULL id
    counts as ''). NULL and wordless texts have no words and are clean; rows that repeat an id
    are judged each on its own; an empty ``df`` gives an empty result, an empty benchmark none that are
    contaminated; other columns are ignored.
    """
    scratch = scratch or Scratch(df.sparkSession, "decontaminate")
    index = build_index(df, scratch, id_col, text_col)
    parts = [_judged(matches(index, block, window, slop), block, id_col) for block in _blocks(benchmark, item_col, item_text_col, block_bytes)]
    if len(parts) == 1:
        out = parts[0]
    else:
        parts = [scratch.stage(p, "block") for p in parts]
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        id_ = f"`{id_col}`"
        out = both.groupBy("segment", "ord").agg(F.first(id_).alias(id_col), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    n_hit = F.size("hits").cast("long")
    return out.select(
        f"`{id_col}`", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items",
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def _judged(found: DataFrame, items: list[tuple[object, str | None]], id_col: str) -> DataFrame:
    """``(segment, ord, id_col, n_words, hits, items)``: hit positions and ids of the items found."""
    names = ["" if i is None else str(i) for i, _ in items]
    kind = dict(found.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits, found_items = [], []
            for spans in b.column(4).to_pylist():
                if not spans:
                    hits.append([])
                    found_items.append([])
                    continue
                on = np.zeros(max(s["end"] for s in spans), bool)
                for s in spans:
                    on[s["start"] : s["end"]] = True
                hits.append(np.flatnonzero(on))
                found_items.append(sorted({names[s["item"]] for s in spans}))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(hits, pa.list_(pa.int64())), pa.array(found_items, pa.list_(pa.string()))], names=["segment", "ord", id_col, "n_words", "hits", "items"])

    return found.mapInArrow(run, f"segment string, ord int, `{id_col}` {kind}, n_words bigint, hits array<bigint>, items array<string>")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hit, items found and verdict of every document."""
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
