"""Windows of fixed length that occur more than once in a corpus of symbol sequences.

Shared by the byte and the word operator. Texts are staged as segments of some MB, each with its anchors: places that are chosen by
what is in a window alone, so equal windows have equal anchors; an anchor stands for the windows that chose it, which all lie
in its surroundings. Anchors are told apart by a name and a 128-bit digest of their surroundings. Equal ones of a segment are
one row, and rows are shuffled by name:

* a name that occurs once: no window of that anchor repeats;
* a name and digest that occur twice or more: all windows of these anchors repeat;
* a name that has several digests is contested: the windows of one anchor of each digest are compared by the caller.

Groups are judged while they stream by in sorted order, by looking at neighbouring rows only, so no group is held, and a passage
of most documents is one row a segment. What was found goes back to the segments in one folder per source partition; texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.shared import ParquetFile, Scratch, carry_out, filesystem, part_name, small_batches, trim

#: Marks of an anchor: its surroundings repeat; its windows must be compared.
WHOLE, COMPARE = 1, 2

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hashes:
    """Hashes of all stretches of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)])
        self._down = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE)])
        self._sum = np.r_[np.uint64(0), np.cumsum(symbols * up[:-1], dtype=np.uint64)]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sum[end] - self._sum[start]) * self._down[start] + mixed((end - start).astype(np.uint64)))


@dataclass
class View:
    """Some texts as one sequence: the bytes of place i are ``data[offset[i] : offset[i + 1]]``; texts lie between ``starts`` and ``ends``."""

    data: bytes
    offset: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    #: A 64-bit symbol at each place.
    symbols: np.ndarray

    def digests(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digests of stretches, in halves."""
        of, data = xxhash.xxh3_128_digest, self.data
        whole = b"".join([of(data[x:y]) for x, y in zip(self.offset[low].tolist(), self.offset[high].tolist(), strict=True)])
        both = np.frombuffer(whole, np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The number of the text that each place is in."""
        return np.searchsorted(self.ends, at, side="right")


@dataclass
class Anchors:
    """The anchors of a view, and the ranges of window starts that they stand for."""

    name: np.ndarray
    #: An anchor's place, and its surroundings: from the first to the last place of all windows that may have chosen it.
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    #: Number of the anchor, first and last window start of each range.
    which: np.ndarray
    first: np.ndarray
    last: np.ndarray


_NONE = np.zeros(0, np.int64)


def no_anchors() -> Anchors:
    return Anchors(_NONE.astype(np.uint64), *[_NONE] * 6)


def ranges(own: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(what, first, last)`` of runs of consecutive ``starts`` with equal ``own``."""
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)])
    return own[new], starts[new], starts[np.r_[new[1:], len(own)] - 1]


def minimisers(view: View, length: int, k: int) -> Anchors:
    """A window's anchor is its k-gram of least hash, the first of several (about two in ``length - k + 2`` places are anchors)."""
    n, w = len(view.symbols), length - k + 1
    if n < length:
        return no_anchors()
    hashes = Hashes(view.symbols)
    start = np.arange(n - k + 1)
    name = hashes.of(start, start + k)
    value = (name & np.uint64(0xFFFFFFFF00000000)) | start.astype(np.uint64)
    m = -(-len(value) // w) * w
    block = np.r_[value, np.full(m - len(value), np.uint64(0xFFFFFFFFFFFFFFFF))].reshape(-1, w)
    before = np.minimum.accumulate(block, axis=1).ravel()
    after = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - length + 1)
    own = (np.minimum(after[starts], before[starts + w - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    inside = view.text_of(starts) == view.text_of(starts + length - 1)
    starts, own = starts[inside], own[inside]
    if not len(starts):
        return no_anchors()
    what, first, last = ranges(own, starts)
    at, which = np.unique(what, return_inverse=True)
    text = view.text_of(at)
    return Anchors(name[at], at, np.maximum(at - (length - k), view.starts[text]), np.minimum(at + length, view.ends[text]), which, first, last)


@dataclass
class Shape:
    """How texts become a sequence, the length of windows, and how these choose anchors."""

    view: Callable[[list[str]], View]
    length: int
    anchors: Callable[[View], Anchors]


#: The ranges of a segment's anchors: the pair (name and digest) of each, whether it is of the pair's first anchor, first and last window start.
_RANGES = pa.struct([("pair", pa.int32()), ("lead", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())])


def _described(shape: Shape, texts: list[str]) -> list[pa.Array]:
    """Name, halves of the digest, and whether there are several, of each pair; and the ranges."""
    view = shape.view(texts)
    a = shape.anchors(view)
    one, two = view.digests(a.low, a.high) if len(a.at) else (a.name, a.name)
    one = one ^ mixed((a.at - a.low).astype(np.uint64) + np.uint64(77))
    order = np.lexsort((two, one, a.name))
    x, y, z = a.name[order], one[order], two[order]
    new = np.r_[np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])]
    head = np.flatnonzero(new)
    pair = np.empty(len(x), np.int32)
    pair[order] = np.cumsum(new) - 1
    lead = np.zeros(len(x), bool)
    lead[order[head]] = True
    many = np.diff(np.r_[head, len(x)]) > 1
    found = pa.StructArray.from_arrays([pa.array(pair[a.which]), pa.array(lead[a.which]), pa.array(a.first.astype(np.int32)), pa.array(a.last.astype(np.int32))], fields=list(_RANGES))
    listed = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    return [listed(pa.array(v)) for v in (x[head].view(np.int64), y[head].view(np.int64), z[head].view(np.int64), many)] + [listed(found)]


def segments(df: DataFrame, scratch: Scratch, shape: Shape, id_col: str, text_col: str, limit: int) -> DataFrame:
    """Staged segments: whole texts, together up to ``limit`` characters or one longer text, with their pairs and ranges."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        id_type = None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([ids], pa.list_(id_type)), pa.array([texts], pa.list_(pa.string())), *_described(shape, texts)], names=["segment", "ids", "texts", "name", "one", "two", "many", "ranges"])

        for b in batches:
            id_type = b.schema.field(0).type
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = text or ""
                if ids and size + len(text) > limit:
                    yield done()
                    trim()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(id_)
                texts.append(text)
                size += len(text)
        if ids:
            yield done()

    source = df.select(f"`{id_col}`", F.col(f"`{text_col}`").cast("string").alias("text"))
    pairs = "name array<bigint>, one array<bigint>, two array<bigint>, many array<boolean>, ranges array<struct<pair:int,lead:boolean,first:int,last:int>>"
    return scratch.put(source, "segments", run, f"segment bigint, ids array<{kind}>, texts array<string>, {pairs}")


@dataclass
class Segment:
    """A segment as a task sees it: its ids and texts, and the ranges of its anchors with their marks."""

    number: int
    ids: pa.Array
    texts: list[str]
    first: np.ndarray
    last: np.ndarray
    lead: np.ndarray
    mark: np.ndarray
    #: The names of the ranges' anchors, as far as they are asked for.
    name: np.ndarray | None = None

    def repeating(self) -> np.ndarray:
        """Starts of the windows that repeat for sure."""
        on = self.mark & WHOLE > 0
        return runs_of(self.first[on], self.last[on])

    def contested(self) -> np.ndarray:
        """Numbers of the ranges whose windows are to be compared."""
        return np.flatnonzero((self.mark & COMPARE > 0) & self.lead)


def runs_of(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of some ranges."""
    size = last - first + 1
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


@dataclass
class Corpus:
    """A staged corpus of segments."""

    segments: DataFrame
    scratch: Scratch

    def repeated_anchors(self) -> str:
        """The folder of notes ``(k, mark)`` about pairs whose name occurs twice or more."""
        rows = self.segments.select("segment", F.posexplode(F.arrays_zip("name", "one", "two", "many")).alias("k", "p")).select("p.name", "p.one", "p.two", "p.many", "segment", "k")
        return note(dealt(rows, "name", "one", "two").mapInArrow(_judged_pairs, "segment bigint, k int, mark tinyint"), self.scratch, "anchors")

    def each(self, marks: str, of_segment: Callable, schema: str, *, folders: tuple[str, ...] = (), names: bool = False) -> DataFrame:
        """``of_segment(Segment, *notes)`` gives record batches; notes are what the folders hold of it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    number, found = b.column(0)[i].as_py(), b.column(3)[i].values
                    pair, lead, first, last = (found.field(f).to_numpy(zero_copy_only=False) for f in ("pair", "lead", "first", "last"))
                    told = noted(marks, number)
                    mark = np.zeros(int(pair.max(initial=-1)) + 1, np.int8)
                    mark[told["k"]] = told["mark"]
                    yield from of_segment(Segment(number, b.column(1).slice(i, 1).flatten(), b.column(2)[i].as_py(), first.astype(np.int64), last.astype(np.int64), lead, mark[pair], b.column(4)[i].values.to_numpy()[pair] if names else None), *(noted(f, number) for f in folders))
                trim()

        return self.segments.select("segment", "ids", "texts", "ranges", *["name"] * names).mapInArrow(run, schema)


def dealt(rows: DataFrame, key: str, *more: str) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, *more)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list]]:
    """Batches with the row before and after each, as lists of the batch's columns' values (or None)."""
    held, before = None, None
    for b in batches:
        if not b.num_rows:
            continue
        if held is not None:
            yield held, before, [c[0].as_py() for c in b.columns]
            before = [c[-1].as_py() for c in held.columns]
        held = b
    if held is not None:
        yield held, before, None


def same(batch: pa.RecordBatch, before, after, columns: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row equals the one before and the one after in some columns."""
    inner, first, last = np.ones(batch.num_rows - 1, bool), before is not None, after is not None
    for c in columns:
        v = batch.column(c).to_numpy()
        inner &= v[1:] == v[:-1]
        first = first and v[0] == before[c]
        last = last and v[-1] == after[c]
    return np.r_[first, inner], np.r_[inner, last]


def _judged_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, before, after in _neighbours(batches):
        n0, n1 = same(b, before, after, (0,))
        p0, p1 = same(b, before, after, (0, 1, 2))
        whole = b.column(3).to_numpy(zero_copy_only=False) | p0 | p1
        # next to a row of the same name and another digest: alone of its own, or the first or last
        compare = (n0 & ~p0) | (n1 & ~p1)
        on = np.flatnonzero(whole | compare)
        mark = np.where(whole, WHOLE, 0) | np.where(compare, COMPARE, 0)
        yield pa.RecordBatch.from_arrays([b.column(4).take(pa.array(on)), b.column(5).take(pa.array(on)), pa.array(mark[on].astype(np.int8))], names=["segment", "k", "mark"])


def repeated_windows(rows: DataFrame, scratch: Scratch) -> str:
    """Notes ``(k)`` of those of ``rows(one, two, many, segment, k)`` whose digest occurs twice or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, before, after in _neighbours(batches):
            p0, p1 = same(b, before, after, (0, 1))
            on = pa.array(np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False) | p0 | p1))
            yield pa.RecordBatch.from_arrays([b.column(3).take(on), b.column(4).take(on)], names=["segment", "k"])

    return note(dealt(rows, "one", "two").mapInArrow(run, "segment bigint, k int"), scratch, "windows")


def note(rows: DataFrame, scratch: Scratch, name: str) -> str:
    """Write ``rows`` so that those about the segments of one source partition are in a folder of their own, by segment."""
    folder = scratch.folder(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, out, n = None, None, 0
        for b in batches:
            of = b.column(b.num_columns - 1).to_numpy()
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist() if len(of) else []
            for lo, hi in zip(first, [*first[1:], len(of)], strict=True):
                if out is None or of[lo] != bucket:
                    if out is not None:
                        out.close()
                    bucket = of[lo]
                    out = ParquetFile(f"{folder}/bucket={bucket}", part_name())
                out.write(b.slice(lo, hi - lo).select(range(b.num_columns - 1)))
            n += len(of)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["rows"])

    told = rows.withColumn("bucket", F.shiftright("segment", 32))
    carry_out(told.repartition("bucket").sortWithinPartitions("bucket", "segment").mapInArrow(run, "rows bigint"))
    return folder


#: The bucket last read of each folder, in a worker.
_HELD: dict[str, tuple[int, dict[str, np.ndarray]]] = {}


def noted(folder: str, segment: int) -> dict[str, np.ndarray]:
    """A segment's columns in a folder of notes; empty if there are none."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    bucket = segment >> 32
    if _HELD.get(folder, (None,))[0] != bucket:
        fs, path = filesystem(f"{folder}/bucket={bucket}")
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
        found = [pq.read_table(fs.open_input_file(f)) for f in sorted(files)]
        table = pa.concat_tables(found).sort_by("segment") if found else None
        while len(_HELD) > 3:
            _HELD.pop(next(iter(_HELD)))
        _HELD[folder] = bucket, {c: table.column(c).to_numpy() for c in table.column_names} if table else {}
    held = _HELD[folder][1]
    if not held:
        return dict.fromkeys(("k", "mark", "first", "last"), np.zeros(0, np.int32))
    lo, hi = np.searchsorted(held["segment"], [segment, segment + 1])
    return {c: v[lo:hi] for c, v in held.items()}


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of one of the starts."""
    step = np.zeros(n + length + 1, np.int32)
    starts = np.unique(starts)
    step[starts] += 1
    step[starts + length] -= 1
    return np.cumsum(step)[:n] > 0
