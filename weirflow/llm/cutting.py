"""Cutting texts into the words of the byte-level tokenizers' pattern, many texts at once.

The pattern takes, from the left: a contraction ('s 't 're 've 'm 'll 'd), letters, numbers or other characters, each with
one blank before it, or white space, whose last character is left to what follows. So where words begin follows from each
character's class and that of its neighbours, and is found for a batch of texts with a few array operations.
The classes are those of the library that is to be equalled: they are asked of it for every code point.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: The pattern that is cut here; others are left to the ``regex`` module.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: Characters that are cut at a time, to bound the arrays.
PIECE = 1 << 20


def all_characters() -> str:
    """Every code point but the surrogates."""
    return np.r_[0:0xD800, 0xE000:0x110000].astype("<u4").tobytes().decode("utf-32-le")


def _ranges(find: Callable[[str, str], str]) -> list[tuple[int, int, int]]:
    """``(first, last, class)`` of all runs of letters, numbers and white space; ``find(class, text)`` gives a text's characters of a class."""
    out, text = [], all_characters()
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        at = np.frombuffer(find(pattern, text).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1]) if len(at) else np.zeros(0, np.int64)
        last = np.r_[first[1:], len(at)] - 1
        out += [(int(a), int(b), kind) for a, b in zip(at[first], at[last], strict=True)]
    return out


@functools.cache
def tiktoken_classes() -> tuple[tuple[int, int, int], ...]:
    """The classes as tiktoken has them."""
    import tiktoken

    def find(pattern: str, text: str) -> str:
        of = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        return bytes(of.encode_ordinary(text)).decode()

    return tuple(_ranges(find))


@functools.cache
def tokenizers_classes() -> tuple[tuple[int, int, int], ...]:
    """The classes as the tokenizers library has them."""
    from tokenizers import Regex, pre_tokenizers

    def find(pattern: str, text: str) -> str:
        step = 1 << 14
        of = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        return "".join(x for i in range(0, len(text), step) for x, _ in of.pre_tokenize_str(text[i : i + step]))

    return tuple(_ranges(find))


@functools.cache
def table_of(ranges: tuple[tuple[int, int, int], ...]) -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for first, last, kind in ranges:
        out[first : last + 1] = kind
    return out


_ONE, _TWO = np.zeros(128, bool), {(ord(a), ord(b)) for a, b in ("re", "ve", "ll")}
_ONE[[ord(c) for c in "stmd"]] = True


def _cut(texts: list[str], table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of some texts with one more of a NUL after each text, which of them are those, and how many words each text has."""
    joined = "\0".join(texts) + "\0"
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    k = table[c]
    k[ends] = END
    n = len(c)
    start = np.ones(n + 1, bool)
    np.not_equal(k[1:], k[:-1], out=start[1:n])
    start[ends] = start[ends + 1] = True
    # the last of some white space goes with what follows, and a blank is part of that
    before = (k[:-1] == SPACE) & (k[1:] < SPACE)
    start[: n - 1] |= before
    start[1:n] &= ~(before & (c[:-1] == 32))
    at = np.flatnonzero(c == 39)
    if len(at):
        last = np.where(at > 0, k[at - 1], END)
        at = at[(last == LETTER) | (last == NUMBER) | (last == END) | ((last == SPACE) & (c[at - 1] != 32))]
        one, two = c[at + 1], c[np.minimum(at + 2, n - 1)]
        short = (one < 128) & _ONE[np.minimum(one, 127)]
        long = np.zeros(len(at), bool)
        for a, b in _TWO:
            long |= (one == a) & (two == b)
        start[at[short | long] + 1] = False
        start[at[short] + 2] = True
        start[at[long] + 3] = True
    first = np.flatnonzero(start[:n])
    width = np.ones(n, np.int32)
    for limit in (0x7F, 0x7FF, 0xFFFF):
        width += c > limit
    byte = np.zeros(n + 1, np.int32)
    np.cumsum(width, out=byte[1:])
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.r_[byte[first], byte[n]].astype(np.int32)), pa.py_buffer(joined.encode()))
    stop = k[first] == END
    total = np.cumsum(~stop)[stop]
    return words, stop, np.diff(total, prepend=0)


def cut(texts: list[str], table: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(distinct words, number of each word in order, words per text)``."""
    chunks, stops, counts, at = [], [], [], 0
    while at < len(texts):
        size, last = 0, at
        while last < len(texts) and (last == at or size + len(texts[last]) <= PIECE):
            size += len(texts[last])
            last += 1
        words, stop, n = _cut(texts[at:last], table)
        chunks.append(words.dictionary_encode())
        stops.append(stop)
        counts.append(n)
        at = last
    if not chunks:
        return pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64)
    joined = pa.chunked_array(chunks).unify_dictionaries()
    codes = np.concatenate([x.indices.to_numpy()[~s] for x, s in zip(joined.chunks, stops, strict=True)])
    return joined.chunk(joined.num_chunks - 1).dictionary, codes, np.concatenate(counts)


def cut_by(texts: list[str], find: Callable[[str], list[str]]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """As :func:`cut`, by any function that lists a text's words."""
    number: dict[str, int] = {}
    codes, counts = [], []
    for t in texts:
        words = find(t)
        counts.append(len(words))
        codes.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
    return pa.array(list(number), pa.string()), np.concatenate(codes) if codes else np.zeros(0, np.int32), np.array(counts, np.int64)
