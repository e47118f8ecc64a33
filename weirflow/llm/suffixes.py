"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Only what can repeat reaches a suffix array: the stretches around anchors that several texts share (see
``repeats``), dealt out so that stretches with the same anchor meet. A task takes them in shards of about a MB:
Larsson-Sadakane refinement sorts a shard's suffixes, Kasai's method gives the common prefixes of
neighbours, and neighbours that share the whole window are repeats. An anchor with more stretches than a shard
holds is spread over several; a shard's windows are then looked up by binary search in the sorted
windows of the shards before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.repeats import Corpus, Segment, Shape, View, covered, dealt, minimisers, note, runs_of, segments
from weirflow.llm.shared import Scratch

WINDOW = 200
#: Bytes in an anchor.
ANCHOR = 40
#: Characters in a segment, and bytes in a shard.
SEGMENT, SHARD = 1 << 20, 1 << 20
#: Chains that Kasai's method follows at once.
CHAINS = 2048


def _packed(t: np.ndarray) -> np.ndarray:
    """Seven bytes from each place on as one number, zeros after the end."""
    x = np.r_[t, np.zeros(7, np.uint8)].astype(np.int64)
    out = np.zeros(len(t), np.int64)
    for j in range(7):
        out = (out << 8) | x[j : j + len(t)]
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of ``t`` in order.

    Larsson-Sadakane: suffixes with equal first h bytes are a group; each round sorts only the groups of several
    by the group of the suffix h further on, which doubles h.
    """
    n = len(t)
    key = _packed(t)
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    head = np.r_[True, k[1:] != k[:-1]]
    h = 7
    while True:
        first = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank = np.empty(n + 1, np.int64)
        rank[sa] = first + 1
        rank[n] = 0
        alone = head & np.r_[head[1:], True]
        on = np.flatnonzero(~alone)
        if not len(on):
            return sa
        part = sa[on]
        key = rank[part] * (n + 2) + rank[np.minimum(part + h, n)]
        order = np.argsort(key, kind="stable")
        sa[on] = part[order]
        k = key[order]
        head[on] = np.r_[True, k[1:] != k[:-1]]
        h *= 2


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Bytes, up to ``most``, that each suffix of ``sa`` has in common with the one before it.

    Kasai: going through the text, a common prefix is at most one shorter than the last. Many stretches
    of the text are gone through at once.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    words = np.r_[_packed(t), np.full(8, -1)]
    bytes_ = np.r_[t.astype(np.int16), np.full(8, -1, np.int16)]
    m = -(-n // CHAINS)
    start = np.arange(0, n, m)
    h = np.zeros(len(start), np.int64)
    out = np.zeros(n, np.int64)
    for step in range(m):
        i = start + step
        live = i < n
        i, h = i[live], h[live]
        start = start[live]
        j = before[i]
        h = np.where(j < 0, 0, np.maximum(h - 1, 0))
        go = np.flatnonzero((j >= 0) & (h < most))
        while len(go):
            a, b = i[go] + h[go], j[go] + h[go]
            far = np.maximum(a, b)
            go, a, b = go[far + 7 <= n], a[far + 7 <= n], b[far + 7 <= n]
            go = go[words[a] == words[b]]
            h[go] += 7
            go = go[h[go] < most]
        go = np.flatnonzero((j >= 0) & (h < most))
        while len(go):
            a, b = i[go] + h[go], j[go] + h[go]
            ok = (np.maximum(a, b) < n) & (bytes_[np.minimum(a, n)] == bytes_[np.minimum(b, n)])
            go = go[ok]
            h[go] += 1
            go = go[h[go] < most]
        h = np.minimum(h, most)
        out[i] = h
    return out[sa]


def repeats_in(contents: list[bytes], window: int) -> np.ndarray:
    """Starts, in all contents put together, of windows inside one content that occur in several places."""
    t = np.frombuffer(b"".join(contents), np.uint8)
    ends = np.cumsum([len(c) for c in contents])
    at = np.arange(len(t))
    valid = at + window <= ends[np.minimum(np.searchsorted(ends, at, side="right"), len(ends) - 1)]
    sa = suffix_array(t)
    group = np.cumsum(common_prefixes(t, sa, window) < window)
    several = np.bincount(group, valid[sa]) > 1
    return np.sort(sa[several[group] & valid[sa]])


class _Merged:
    """Sorted windows of the shards so far of one anchor, in runs that at least double, so that taking in a shard is cheap."""

    def __init__(self):
        self.runs: list[list[np.ndarray]] = []

    def add(self, key, segment, pos, told):
        """Take in a shard's windows; returns (segment, pos) of the windows now known to repeat."""
        order = np.lexsort((key[:, 1], key[:, 0]))
        key, segment, pos, told = key[order], segment[order], pos[order], told[order]
        found, known = [], np.zeros(len(key), bool)
        packed = _sortable(key)
        for run in self.runs:
            i = np.minimum(np.searchsorted(run[0], packed), len(run[0]) - 1)
            hit = run[0][i] == packed
            old = np.unique(i[hit & ~run[3][i]])
            run[3][old] = True
            found.append((run[1][old], run[2][old]))
            known |= hit
        found.append((segment[known & ~told], pos[known & ~told]))
        fresh = ~known & np.r_[True, packed[1:] != packed[:-1]]
        if fresh.any():
            self.runs.append([packed[fresh], segment[fresh], pos[fresh], told[fresh]])
            while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
                x, y = self.runs.pop(), self.runs.pop()
                joined = [np.concatenate(c) for c in zip(y, x, strict=True)]
                order = np.argsort(joined[0], kind="stable")
                self.runs.append([c[order] for c in joined])
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _sortable(key: np.ndarray) -> np.ndarray:
    """Digests as values of 16 bytes that numpy sorts and searches."""
    return np.ascontiguousarray(key.astype(">u8")).view("S16").ravel() if len(key) else np.zeros(0, "S16")


def _sharded(window: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0
        merged, of_name = _Merged(), None

        def solve(goes_on: bool):
            nonlocal merged, of_name
            names, segment, first = (np.array([h[i] for h in held], np.int64) for i in range(3))
            # equal contents count once in the suffix array, and all their windows repeat
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(h[3], len(number)) for h in held])
            contents = list(number)
            lengths = np.array([len(c) for c in contents], np.int64)
            base = np.cumsum(lengths) - lengths
            starts = np.zeros(int(lengths.sum()), bool)
            starts[repeats_in(contents, window)] = True
            for u in np.flatnonzero(np.bincount(which) > 1).tolist():
                starts[base[u] : base[u] + lengths[u] - window + 1] = True
            n = lengths[which] - window + 1
            who = np.repeat(np.arange(len(held)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            where = base[which][who] + offset
            pos, told = first[who] + offset, starts[where]
            out = [(segment[who][told], pos[told])]
            last = int(names[-1])
            data = b"".join(contents)
            for name in dict.fromkeys([int(names[0])] * (int(names[0]) == of_name) + [last] * goes_on):
                if name != of_name:
                    merged, of_name = _Merged(), name
                on = np.flatnonzero(names[who] == name)
                key = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[i : i + window]) for i in where[on].tolist()]), np.uint64).reshape(-1, 2)
                out.append(merged.add(key, segment[who[on]], pos[on], told[on]))
            if not goes_on:
                of_name = None
            s, p = (np.concatenate(x) for x in zip(*out, strict=True))
            order = np.lexsort((p, s))
            s, p = s[order], p[order]
            new = np.flatnonzero(np.r_[np.ones(min(1, len(s)), bool), (s[1:] != s[:-1]) | (p[1:] > p[:-1] + 1)])
            return pa.RecordBatch.from_arrays([pa.array(s[new]), pa.array(p[new].astype(np.int32)), pa.array(p[np.r_[new[1:], len(s)] - 1].astype(np.int32) if len(s) else p.astype(np.int32))], names=["segment", "first", "last"])

        for b in batches:
            for name, segment, first, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and size + len(content) > shard:
                    yield solve(name == held[-1][0])
                    held, size = [], 0
                held.append((name, segment, first, content))
                size += len(content)
        if held:
            yield solve(False)

    return run


def _view(texts: list[str]) -> View:
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined, ends = b"".join(data), np.cumsum([len(x) for x in data])
    return View(joined, np.arange(len(joined) + 1), np.r_[0, ends[:-1]], ends, np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard: int = SHARD, scratch: Scratch | None = None, segment: int = SEGMENT) -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, kept)`` per row; kept is the remaining UTF-8 bytes (binary).

    A byte goes if a string of ``window`` bytes of its text that covers it starts anywhere else too, in
    the same text or another, overlaps included; strings are judged on the input. NULL and empty texts have
    no bytes; rows that repeat a text lose it all if it is long enough; an empty table gives an empty result;
    other columns are ignored. A very long text is a segment of its own.
    """
    scratch = scratch or Scratch(df.sparkSession, "suffixes")
    kind = dict(df.dtypes)[id_col]
    k = min(ANCHOR, max(1, window // 2))
    shape = Shape(_view, window, lambda view: minimisers(view, window, k))
    corpus = Corpus(segments(df, scratch, shape, id_col, text_col, segment), scratch)
    marks = corpus.repeated_anchors()

    def contested(s: Segment) -> Iterator[pa.RecordBatch]:
        on = s.contested()
        if not len(on):
            return
        first, last = s.first[on], s.last[on]
        data = b"".join(t.encode("utf-8", "surrogatepass") for t in s.texts)
        contents = [data[a : b + window] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(s.name[on]), pa.array(np.full(len(first), s.number)), pa.array(first.astype(np.int32)), pa.array(contents, pa.binary())], names=["name", "segment", "first", "content"])

    rows = corpus.each(marks, contested, "name bigint, segment bigint, first int, content binary", names=True)
    windows = note(dealt(rows, "name").mapInArrow(_sharded(window, shard), "segment bigint, first int, last int"), scratch, "windows")

    def keep(s: Segment, more: dict) -> Iterator[pa.RecordBatch]:
        data = [t.encode("utf-8", "surrogatepass") for t in s.texts]
        ends = np.cumsum([len(x) for x in data])
        gone = covered(np.r_[s.repeating(), runs_of(more["first"].astype(np.int64), more["last"].astype(np.int64))], window, int(ends[-1]))
        removed, spans, kept = [], [], []
        for x, end in zip(data, ends, strict=True):
            g = gone[end - len(x) : end]
            removed.append(int(g.sum()))
            spans.append(int((g[1:] & ~g[:-1]).sum() + g[:1].sum()))
            kept.append(np.frombuffer(x, np.uint8)[~g].tobytes() if removed[-1] else x)
        yield pa.RecordBatch.from_arrays([s.ids, pa.array([len(x) for x in data], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    return corpus.each(marks, keep, f"`{id_col}` {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", folders=(windows,))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeated strings take away, and a digest of what stays."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
