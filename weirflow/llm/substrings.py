"""Removal of word passages that occur more than once, by recompression.

Rounds name the words of all texts alike: in each, a run of equal symbols becomes one symbol, then symbols are parted at random into left
and right ones, and each left one that a right one follows becomes one symbol with it. Names are hashes of what they stand for, so
that they are the same in all tasks without a table. Whether two symbols are joined depends on them and their neighbours alone, so each symbol
has a stretch of words, its domain, that determines it: a window that holds the domain holds the symbol, wherever it occurs, and the
parse at a window's ends, which may differ, takes no part. Of the symbols that are inside a window in this sense, one of the highest
level that the rounds reached is its anchor (level 0, the words themselves, at worst). Symbols that several texts share, with their domains, reveal repeats;
these are then verified by 128-bit digests of the words themselves (see ``repeats``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.repeats import Anchors, Corpus, Hashes, Segment, Shape, View, covered, mixed, no_anchors, ranges, repeated_windows, runs_of, segments
from weirflow.llm.shared import Scratch

WINDOW = 35
#: Characters in a segment.
SEGMENT = 4 << 20
#: Rounds at most. Each makes domains longer, so that fewer are shared by chance, and leaves a window fewer symbols to choose from, so that
#: there are more anchors: 3 rounds give an anchor in 12 words, with a domain of some 14 words; 5 rounds one in 4.
ROUNDS = 3
_PAIR, _RUN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


def _view(texts: list[str]) -> View:
    """The words of all texts, each with a space, and a place without bytes after every text."""
    known: dict[bytes, int] = {}
    of = xxhash.xxh3_64_intdigest
    parts, sizes, counts, data = [], [], [], []
    end = np.zeros(1, np.uint64)
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").split()
        for w in words:
            if w not in known:
                known[w] = of(w) or 1
        parts += [np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), end]
        sizes += [np.fromiter(map(len, words), np.int64, len(words)) + 1, [0]]
        counts.append(len(words))
        data.append(b" ".join(words) + b" " * bool(words))
    counts = np.array(counts, np.int64)
    ends = np.cumsum(counts + 1) - 1
    return View(b"".join(data), np.r_[0, np.cumsum(np.concatenate(sizes)) if sizes else []].astype(np.int64), ends - counts, ends, np.concatenate(parts) if parts else end[:0])


class Level:
    """The symbols of a round in order, and where their domains begin and end; symbol 0 ends a text and is never joined."""

    def __init__(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray, number: int = 0):
        self.symbol, self.low, self.high, self.number = symbol, low, high, number

    def next(self, n: int) -> Level:
        """The next round: runs, then pairs. ``n`` places there are in all."""
        s, low, high = self.symbol, self.low, self.high
        number = np.uint64(self.number + 1)
        head = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (s[1:] == 0)])
        size = np.diff(np.r_[head, len(s)])
        run, several = s[head], size > 1
        run[several] = mixed(run[several] * _RUN + mixed(size[several].astype(np.uint64) + (number << np.uint64(40)))) | np.uint64(1)
        # a run is known with the symbols before and after it
        low = np.r_[-1, low[head[1:] - 1]]
        high = np.r_[high[head[1:]], n + 1]
        right = mixed(run + mixed(np.full(1, number)) * _PAIR) >> np.uint64(63) > 0
        on = run != 0
        left, right = on & ~right, on & right
        joins = np.r_[left[:-1] & right[1:], False]
        joined = np.r_[False, joins[:-1]]
        # what a left symbol becomes is known with the one after it, a right one that is not joined with the one before
        low = np.where(right, np.r_[-1, low[:-1]], low)
        high = np.where(left, np.r_[high[1:], n + 1], high)
        at = np.flatnonzero(joins)
        run[at] = mixed(mixed(run[at] + number) * _PAIR + run[at + 1]) | np.uint64(1)
        return Level(run[~joined], low[~joined], high[~joined], self.number + 1)


def levels(symbols: np.ndarray, window: int) -> list[Level]:
    """The rounds, from the words on, as long as some domain fits a window."""
    n = len(symbols)
    out = [Level(symbols, np.arange(n), np.arange(n) + 1)]
    while len(out) <= ROUNDS:
        level = out[-1].next(n)
        if not ((level.high - level.low <= window) & (level.symbol != 0)).any():
            break
        out.append(level)
    return out


def anchors(view: View, window: int) -> Anchors:
    """A window's anchor is, of the symbols of the highest level whose domains it holds, the one of least hash, the first of several."""
    n = len(view.symbols)
    if n < window:
        return no_anchors()
    gaps = np.r_[0, np.cumsum(view.symbols == 0)]
    open_ = np.flatnonzero(gaps[window:] == gaps[:-window])
    if not len(open_):
        return no_anchors()
    own, level_of = np.full(n, -1, np.int64), np.zeros(n, np.int8)
    rounds = levels(view.symbols, window)
    for level in reversed(rounds):
        # the symbols whose domain a window holds are next to each other: both ends of the domains ascend
        starts_before = np.cumsum(np.bincount(level.low + 1, minlength=n + 2))
        ends_by = np.cumsum(np.bincount(level.high, minlength=n + 2))
        a, b = starts_before[open_], ends_by[open_ + window]
        has = b > a
        if not has.any():
            continue
        a, b, at = a[has], b[has], open_[has]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        value = (mixed(level.symbol) & ~np.uint64(0xFFFFFFFF)) | np.arange(len(level.symbol), dtype=np.uint64)
        value[level.symbol == 0] = np.uint64(0xFFFFFFFFFFFFFFFF)
        least = np.minimum.reduceat(np.r_[value, value[-1:]], np.stack([a[new], b[new]], axis=1).ravel())[::2]
        own[at] = np.repeat((least & np.uint64(0xFFFFFFFF)).astype(np.int64), np.diff(np.r_[new, len(at)]))
        level_of[at] = level.number
        open_ = open_[~has]
        if not len(open_):
            break
    starts = np.flatnonzero(own >= 0)
    what, first, last = ranges(own[starts] | level_of[starts].astype(np.int64) << 32, starts)
    node, which = np.unique(what, return_inverse=True)
    number, k = node >> 32, node & 0xFFFFFFFF
    low, high, symbol = np.empty(len(node), np.int64), np.empty(len(node), np.int64), np.empty(len(node), np.uint64)
    for level in rounds:
        on = number == level.number
        low[on], high[on], symbol[on] = level.low[k[on]], level.high[k[on]], level.symbol[k[on]]
    name = Hashes(view.symbols).of(low, high) ^ mixed(symbol + number.astype(np.uint64))
    text = view.text_of(low)
    return Anchors(name, low, np.maximum(high - window, view.starts[text]), np.minimum(low + window, view.ends[text]), which, first, last)


def _windows(segment: Segment, view: View, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contested windows of a segment: halves of the digests of the distinct ones, whether each is there several times, all starts, and the number of each."""
    on = segment.contested()
    at = runs_of(segment.first[on], segment.last[on])
    one, two = view.digests(at, at + window) if len(at) else (np.zeros(0, np.uint64),) * 2
    order = np.lexsort((two, one))
    x, y = one[order], two[order]
    new = np.r_[np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    head = np.flatnonzero(new)
    return x[head], y[head], np.diff(np.r_[head, len(x)]) > 1, at[order], np.cumsum(new) - 1


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, scratch: Scratch | None = None, segment: int = SEGMENT) -> DataFrame:
    """``(id_col, n_words, n_removed, kept)`` per row; kept is the remaining words joined by one space.

    A word goes if a window of ``window`` words of its text that covers it starts anywhere else too, in the same
    text or another; windows are judged on the input. NULL and empty texts have no words; rows that
    repeat a text lose it all if it is long enough; an empty table gives an empty result; other columns are ignored. A very long
    text is a segment of its own.
    """
    scratch = scratch or Scratch(df.sparkSession, "substrings")
    kind = dict(df.dtypes)[id_col]
    shape = Shape(_view, window, lambda view: anchors(view, window))
    corpus = Corpus(segments(df, scratch, shape, id_col, text_col, segment), scratch)
    marks = corpus.repeated_anchors()

    def contested(s: Segment) -> Iterator[pa.RecordBatch]:
        one, two, many, _, _ = _windows(s, _view(s.texts), window) if len(s.contested()) else [np.zeros(0, np.int64)] * 5
        if len(one):
            yield pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(many), pa.array(np.full(len(one), s.number)), pa.array(np.arange(len(one), dtype=np.int32))], names=["one", "two", "many", "segment", "k"])

    windows = repeated_windows(corpus.each(marks, contested, "one bigint, two bigint, many boolean, segment bigint, k int"), scratch)

    def keep(s: Segment, more: dict) -> Iterator[pa.RecordBatch]:
        words = [t.encode("utf-8", "surrogatepass").split() for t in s.texts]
        counts = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(counts + 1) - 1
        starts = s.repeating()
        if len(more["k"]):
            _, _, _, at, number = _windows(s, _view(s.texts), window)
            on = np.zeros(int(number[-1]) + 1, bool)
            on[more["k"]] = True
            starts = np.r_[starts, at[on[number]]]
        gone = covered(starts, window, int(ends[-1]) + 1)
        removed, kept = [], []
        for w, end in zip(words, ends, strict=True):
            g = gone[end - len(w) : end]
            removed.append(int(g.sum()))
            kept.append(b" ".join([x for x, y in zip(w, g.tolist(), strict=True) if not y] if removed[-1] else w).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([s.ids, pa.array(counts), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", "kept"])

    return corpus.each(marks, keep, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept string", folders=(windows,))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeated passages take away, and a digest of what stays."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
