"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within the radius r = 3 meet on a common variant: both emit all variants within half
the radius. Half of 3 is not whole, so the odd unit is spent by masking: the 64 bits are cut into three
blocks; with one block masked, a pair at distance 3 whose bits are not all in one block has a masked block
that holds exactly one of them, and the two sides meet on a variant of the 42 or 43 remaining bits within
distance 1 of each. A pair whose bits all lie in one block agrees on the remaining bits and meets there.
So every fingerprint emits 3 x (1 + 42 or 43) variants, not the 2,081 of a ball of radius 2.

Inside a bucket (one variant), members are not paired with each other. Members with equal masked bits
are within 2 of each other and are chained; members whose masked bits differ in one bit are found by looking
up each single flip; members that agree on all other bits are joined through the single-bit balls of their
masked bits. All links have been verified to lie within the radius; the number of lookups is linear in the bucket's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.components import components, stars
from weirflow.llm.shared import Scratch, small_batches

RADIUS = 3
SEED = 42
SHINGLE = 3
#: (first bit, bits) of the blocks that are masked in turn.
BLOCKS = ((0, 21), (21, 21), (42, 22))

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Rows of sorted variants that are looked through at a time.
_ROWS = 400_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text; 0 if it is NULL or has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    of = xxhash.xxh64_intdigest
    hashes = np.fromiter((of(g, SEED) for g in grams), np.uint64)
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        total += np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int) -> tuple[DataFrame, Callable, str]:
    """What is read for :func:`fingerprints`, what makes them of it, and their schema."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=[id_col, "fp"])

    kind = dict(df.dtypes)[id_col]
    return df.select(f"`{id_col}`", F.col(f"`{text_col}`").cast("string").alias("text")), run, f"`{id_col}` {kind}, fp bigint"


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id_col, fp)`` of every row; fp is the fingerprint's 64 bits as a long."""
    source, run, schema = _fingerprints(df, id_col, text_col, shingle)
    return source.mapInArrow(run, schema)


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(all_fp), 4096):
            fp = all_fp[lo : lo + 4096]
            for k, (first, bits) in enumerate(BLOCKS):
                mask = np.uint64(((1 << bits) - 1) << first)
                kept = fp & ~mask
                flips = np.array([0] + [1 << j for j in range(64) if not first <= j < first + bits], np.uint64)
                key = (kept[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key), k, np.int8)), pa.array(key.view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))],
                    names=["block", "variant", "fp"],
                )


def _bucket_links(block: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside whole buckets; the rows are sorted by block and key."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1])
    bucket = np.cumsum(new) - 1
    several = np.bincount(bucket)[bucket] > 1
    a, b = [], []
    for k, (first, bits) in enumerate(BLOCKS):
        on = several & (block == k)
        if not on.any():
            continue
        g, f, z = bucket[on].astype(np.int64), fp[on], key[on]
        mask = np.uint64((1 << bits) - 1)
        v = ((f >> np.uint64(first)) & mask).astype(np.int64)
        at = (g << bits) | v
        order = np.argsort(at, kind="stable")
        at, f, z = at[order], f[order], z[order]
        same = at[1:] == at[:-1]
        a.append(f[1:][same])
        b.append(f[:-1][same])
        heads = np.flatnonzero(np.r_[True, ~same])
        _flips(at[heads], f[heads], bits, a, b)
        exact = f & ~np.uint64(int(mask) << first) == z
        _balls(at[exact], f[exact], bits, a, b)
    if not a:
        return fp[:0], fp[:0]
    return stars(np.concatenate(a), np.concatenate(b))


def _flips(at: np.ndarray, f: np.ndarray, bits: int, a: list, b: list) -> None:
    """Link entries of the sorted ``at`` that differ in one of the low bits."""
    for j in range(bits):
        to = at | (1 << j)
        i = np.searchsorted(at, to)
        hit = (to != at) & (i < len(at))
        hit[hit] = at[i[hit]] == to[hit]
        a.append(f[hit])
        b.append(f[i[hit]])


def _balls(at: np.ndarray, f: np.ndarray, bits: int, a: list, b: list) -> None:
    """Link entries that differ in up to three of the low bits, where a bucket has several."""
    _, inv, count = np.unique(at >> bits, return_inverse=True, return_counts=True)
    on = count[inv] > 1
    if not on.any():
        return
    at, f = at[on], f[on]
    ball = np.array([0] + [1 << j for j in range(bits)], np.int64)
    w, owner = (at[:, None] ^ ball[None, :]).ravel(), np.repeat(f, len(ball))
    order = np.argsort(w, kind="stable")
    w, owner = w[order], owner[order]
    same = w[1:] == w[:-1]
    a.append(owner[1:][same])
    b.append(owner[:-1][same])
    heads = np.flatnonzero(np.r_[True, ~same])
    _flips(w[heads], owner[heads], bits, a, b)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    rows = 0
    done: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(last: bool):
        nonlocal held, rows
        block, key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = len(key)
        if not last:  # the last bucket may go on
            cut = int(np.flatnonzero((key != key[-1]) | (block != block[-1]))[-1]) + 1 if ((key != key[-1]) | (block != block[-1])).any() else 0
        done.append(_bucket_links(block[:cut], key[:cut], fp[:cut]) if cut else (fp[:0], fp[:0]))
        held, rows = ([(block[cut:], key[cut:], fp[cut:])] if cut < len(key) else []), len(key) - cut
        a, b = (np.concatenate(x) for x in zip(*done, strict=True))
        done[:] = [stars(a, b)]

    limit = _ROWS
    for x in batches:
        held.append((x.column(0).to_numpy(zero_copy_only=False), x.column(1).to_numpy(zero_copy_only=False).view(np.uint64), x.column(2).to_numpy(zero_copy_only=False).view(np.uint64)))
        rows += x.num_rows
        if rows >= limit:
            flush(False)
            limit = max(_ROWS, 2 * rows)
    if held:
        flush(True)
    if done:
        a, b = done[0]
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fps.fp`` within the radius, as few as a task needs for that."""
    rows = fps.select("fp").mapInArrow(_variants, "block tinyint, variant bigint, fp bigint")
    return rows.repartition("block", "variant").sortWithinPartitions("block", "variant").mapInArrow(_links, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """``(id_col, fingerprint, component_id)``, one row per row of ``df``; other columns are ignored.

    component_id is the least id that can be reached over links of at most three differing bits. Equal
    fingerprints count once before the shuffle, so thousands of copies are one fingerprint. NULL and wordless
    texts have fingerprint 0 and are linked like others; very long texts are hashed whole; rows that repeat
    an id or text stay separate rows of the same component; a NULL id is never a component's least unless all
    are NULL; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(df.sparkSession, "simhash")
    source, run, schema = _fingerprints(df, id_col, text_col, shingle)
    own = scratch.put(source, "fingerprints", run, schema)
    once = scratch.put(own.groupBy("fp").agg(F.min(f"`{id_col}`").alias("least")), "distinct")
    root = components(links(once), scratch).select(F.col("node").alias("fp"), "root")
    joined = once.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = joined.join(ids, "root").select("fp", "component_id")
    return own.join(of_fp, "fp").select(F.col(f"`{id_col}`"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
