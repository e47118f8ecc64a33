"""Near-duplicates by shingle similarity: all pairs of texts whose shingles' Jaccard similarity is 0.8 or more.

SimHash alone misses such pairs: fingerprints of pairs at 0.8 differ in about ten of 64 bits, more than any ball that can be
listed. So candidates come from two sources: SimHash links, and prefix filtering. With the shingles of all
texts in one order, by hash, two sets at 0.8 share a shingle among the first ``n - ceil(0.8 n) + 1`` of each, and ``k + 1`` among as many and
``k`` more. So each set lists a tenth more of its shingles, and does without as many of those listed as a set of its least partner's
size lists more, the most frequent ones as counted over all texts: of what two similar sets list in common the rarest stays in both, and passages that many texts share make no buckets.

A pair's candidates are sieved by bitmaps of their sets' parities: where these differ in more bits than the sets may in
shingles, the pair cannot be similar, so no pair is lost and few texts travel. Every link is verified by the similarity of the whole sets. Links that connect large groups are verified first;
then only pairs of different components are. Buckets of few members list these pairs. Members of larger ones, which
mostly have no more than a passage or a template in common, meet by the rarest of all their shingles instead (:func:`rare_keys`), by
exact counts over these members and for each class of sizes apart; this too leaves no similar pair out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm import simhash
from weirflow.llm.components import components
from weirflow.llm.shared import Scratch, forget, small_batches

SHINGLE = 5
#: Least similarity of near-duplicates, as a fraction.
ABOVE, BELOW = 4, 5
#: Bits in a bitmap.
BITS = 512
#: One in so many shingles of a text is listed beyond the prefix, so that as many of the most frequent need not be met by.
SPARE = 10
#: Members up to which a bucket lists its pairs, rounds in which keys of rare shingles are compared (each takes its share of the disk).
FEW, ROUNDS = 16, 4


def _sizes() -> np.ndarray:
    """The least size of each class of sizes: sizes of similar sets are in one class or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, (out[-1] - 1) * BELOW // ABOVE + 1))
    return np.array(out)


#: Sizes at which classes of sizes begin.
SIZES = _sizes()


def _classes() -> np.ndarray:
    """The least size of each class of nearly equal sizes."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] + max(1, out[-1] // 32))
    return np.array(out)


#: Sizes at which classes of nearly equal sizes begin.
CLASSES = _classes()


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The 64-bit hashes of a text's distinct shingles, ascending; words as :func:`simhash.fingerprint` has them, a shorter text is one."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(simhash._LOWER).split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets of hashes reaches the least one."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return (ABOVE + BELOW) * both >= ABOVE * (len(x) + len(y))


def bitmap(s: np.ndarray) -> np.ndarray:
    """The parities of how many hashes fall on each of the bits, as longs; two bitmaps differ in no more bits than the sets in hashes."""
    return np.packbits((np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers; another number for each."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_keys(s: np.ndarray) -> np.ndarray:
    """Keys of a set of hashes, about half as many; two similar sets have at least one in common, sets that differ
    in most of their hashes the less often the larger they are. :func:`near_duplicates` has :func:`rare_keys` in its place.

    For its class of sizes and the next one a set is dealt by the hashes' values to more parts than similar sets of these classes
    differ in hashes, so one part is the same in both. Each part with hashes gives a key of all of them. A set that leaves as many
    parts empty as there are to spare may have only an empty part in common with another such set; it also gives its first hashes, as
    in prefix filtering.
    """
    n, out = len(s), []
    if not n:
        return np.zeros(0, np.uint64)
    own = int(np.searchsorted(SIZES, n, side="right")) - 1
    for label in (own, own + 1):
        apart = 2 * (int(SIZES[label + 1]) - 1) * (BELOW - ABOVE) // (ABOVE + BELOW)
        parts = apart + 1 + apart // 8
        at = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        name = _mix(at[starts] + np.uint64(label << 40))
        out.append(_mix(np.add.reduceat(s, starts) ^ name))
        if len(starts) <= apart:
            out.append(_mix(s[: n - (ABOVE * n + BELOW - 1) // BELOW + 1] ^ _mix(np.array([(label << 40) + (1 << 39)], np.uint64))))
    return np.concatenate(out)


def rare_keys(s: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, int]]:
    """Keys of a set of ``n`` hashes for each class of sizes that similar sets may have, and the set's side: 0 if that class is its own, else 1 if its own is the lesser one, 2 if the greater one.

    ``s`` are those of its hashes that count, the most frequent first, in one order for all sets. Two similar sets share at least
    four ninths of the sum of their sizes; the last one that they share has so many before it in both that neither does without it if
    each leaves out one less than that of its most frequent, as reckoned with the class's least size.
    """
    least = (ABOVE * n + BELOW - 1) // BELOW
    own, lo, hi = (int(np.searchsorted(CLASSES, x, side="right")) - 1 for x in (n, least, n * BELOW // ABOVE))
    for label in range(lo, hi + 1):
        both = -(-ABOVE * (n + max(least, int(CLASSES[label]))) // (ABOVE + BELOW))
        if len(s) >= both:
            name = _mix(np.array([min(own, label) << 20 | max(own, label)], np.uint64))
            yield _mix(s[both - 1 :] ^ name), (own < label) + 2 * (own > label)


def _sets(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with a row number, the set's hash (node), its size n, fingerprint and first shingles, staged."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            node, size, fp, first, bits = [], [], [], [], []
            for t in b.column(at).to_pylist():
                s = shingles(t)
                n = len(s)
                node.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                size.append(n)
                bits.append(bitmap(s))
                fp.append(simhash.fingerprint(t, SHINGLE))
                first.append(s[: n - (ABOVE * n + BELOW - 1) // BELOW + 1 + n // SPARE].view(np.int64))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, fp)]
            yield pa.RecordBatch.from_arrays([*b.columns, signed[0], pa.array(size, pa.int64()), signed[1], pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(np.arange(row, row + b.num_rows))], names=[*b.schema.names, "__node", "__n", "__fp", "__first", "__bits", "__row"])
            row += b.num_rows

    kinds = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes)
    return scratch.put(docs, "sets", run, f"{kinds}, __node bigint, __n bigint, __fp bigint, __first array<bigint>, __bits array<bigint>, __row bigint")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of ``pairs(a, b)`` that are similar."""
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("n").alias(f"{end}_n"), F.col("bits").alias(f"{end}_bits"))
    apart = " + ".join(f"bit_count(a_bits[{k}] ^ b_bits[{k}])" for k in range(BITS // 64))
    close = f"({apart}) * {ABOVE + BELOW} <= (a_n + b_n) * {BELOW - ABOVE}"
    pairs = scratch.put(pairs.join(of("a"), "a").join(of("b"), "b").where(close).select("a", "b"), "close")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in data], pa.binary())], names=["node", "text"])

    def unpacked(x: bytes) -> str:
        return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True).decode("utf-8", "surrogatepass")

    # texts travel compressed: they are most of what is shuffled
    own = scratch.put(texts.select("node", "text").join(ends, "node", "left_semi"), "texts", packed, "node bigint, text binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            keep = []
            for a, x, y in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if held is None or a != last:
                    last, held = a, shingles(unpacked(x))
                keep.append(alike(held, shingles(unpacked(y))))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    x, y = own.select(F.col("node").alias("a"), F.col("text").alias("x")), own.select(F.col("node").alias("b"), F.col("text").alias("y"))
    links = scratch.put(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y"), "links", run, "a bigint, b bigint")
    scratch.drop_named("close", "texts")
    forget(scratch.spark)
    return links


def _by_rarest(wide: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """``(key, node, n, root, side)`` of the nodes of ``wide(node, root)`` by those keys of their rarest shingles that different roots have."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, root, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s = shingles(text).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), *(pa.array(np.full(len(s), x, np.int64)) for x in (node, len(s), root))], names=["key", "node", "n", "root"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for node, n, root, ms in zip(*(b.column(k) for k in range(4)), strict=True):
                for keys, side in rare_keys(ms.values.to_numpy().view(np.uint64), n.as_py()):
                    same = (pa.array(np.full(len(keys), x.as_py(), np.int64)) for x in (node, n, root))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *same, pa.array(np.full(len(keys), side, np.int8))], names=["key", "node", "n", "root", "side"])

    def shared(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("key", "size")

    # what one root alone has is in no two sets that are still to be compared
    own = scratch.put(texts.join(wide, "node").select("node", "root", "text"), "listed", listed, "key bigint, node bigint, n bigint, root bigint")
    counted = own.join(scratch.put(shared(own), "shared"), "key")
    ordered = counted.groupBy("node", "n", "root").agg(F.sort_array(F.collect_list(F.struct("size", "key")), False).alias("ms"))
    keys = scratch.put(ordered.select("node", "n", "root", "ms.key"), "keys", keyed, "key bigint, node bigint, n bigint, root bigint, side tinyint")
    scratch.drop_named("listed", "shared")
    met = []
    for k in range(ROUNDS):
        some = keys.where(F.pmod("key", F.lit(ROUNDS)) == k)
        met.append(scratch.put(some.join(scratch.put(shared(some).select("key"), "shared"), "key", "left_semi"), "met"))
        forget(scratch.spark)
    scratch.drop_named("keys", "shared")
    return reduce(DataFrame.unionByName, met)


def _apart(members: DataFrame, group: str) -> DataFrame:
    """``(a, b)``: members of a group with different roots whose sizes may be those of similar sets, of different sides if the group has such."""
    x, y = members.alias("x"), members.alias("y")
    pairs = x.join(y, group).where(f"x.root <> y.root and x.node < y.node and x.n * {BELOW} >= y.n * {ABOVE} and y.n * {BELOW} >= x.n * {ABOVE} and (x.side = 0 or x.side <> y.side)")
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with ``__row``, a number of its own for each row, and ``__component``, equal in rows that similar pairs connect.

    Nothing but ``text`` is compared. NULL and wordless texts are alike. Rows with equal sets of shingles are one node.
    """
    scratch = scratch or Scratch(docs.sparkSession, "similar")
    small_batches(docs.sparkSession)
    own = _sets(docs, scratch)
    least = own.groupBy("__node").agg(F.min("__row").alias("__row"))
    nodes = own.select("__row", F.col("__node").alias("node"), F.col("__n").alias("n"), F.col("__bits").alias("bits")).join(least.select("__row"), "__row", "left_semi").drop("__row")
    nodes = scratch.put(nodes, "nodes")
    texts = own.select("__row", F.col("__node").alias("node"), "text").join(least.select("__row"), "__row", "left_semi").drop("__row")
    member = F.struct(F.col("__n").alias("n"), F.col("__node").alias("node"))
    met = own.select(F.explode("__first").alias("key"), member.alias("m")).groupBy("key").agg(F.collect_set("m").alias("ms")).where(F.size("ms") > 1)
    met = scratch.put(met.select("key", F.size("ms").alias("size"), F.explode("ms").alias("m")).select("key", "size", "m.*"), "met")
    order = Window.partitionBy("node").orderBy(F.desc("size"), F.desc("key"))
    rare = met.withColumn("place", F.row_number().over(order)).where(F.expr(f"place > ({ABOVE} * n + {BELOW - 1}) div {BELOW} div {SPARE}"))
    buckets = rare.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("n", "node"))).alias("ms"))
    buckets = scratch.put(buckets.where(F.size("ms") > 1).select("ms").distinct().withColumn("bucket", F.monotonically_increasing_id()), "buckets")
    scratch.drop_named("met")
    stars = buckets.select(F.explode(F.expr("flatten(transform(slice(ms, 2, size(ms)), (m, i) -> array(struct(ms[0] as x, m as y), struct(ms[i] as x, m as y))))")).alias("p")).select("p.x", "p.y")
    stars = stars.where(F.col("x.n") * BELOW >= F.col("y.n") * ABOVE).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    once = scratch.put(own.groupBy("__fp").agg(F.min("__node").alias("node")).withColumnRenamed("__fp", "fp"), "distinct")
    of = lambda end: once.select(F.col("fp").alias(end), F.col("node").alias(f"{end}_node"))
    near = simhash.links(once).join(of("a"), "a").join(of("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    first = stars.unionByName(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    first = scratch.put(first, "pairs")
    links = _verified(first, nodes, texts, scratch)
    root = components(links, scratch)
    members = buckets.select("bucket", F.explode("ms").alias("m")).select("bucket", "m.n", "m.node").join(root, "node", "left").select("bucket", "n", "node", F.coalesce("root", "node").alias("root"))
    open_ = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("bucket", "size")
    members = scratch.put(members.join(open_, "bucket"), "members")
    scratch.drop_named("buckets", "distinct")
    wide = scratch.put(members.where(F.col("size") > FEW).select("node", "root").distinct(), "wide")
    second = _apart(members.where(F.col("size") <= FEW).withColumn("side", F.lit(0)), "bucket").unionByName(_apart(_by_rarest(wide, texts, scratch), "key"))
    second = scratch.put(second.distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    scratch.drop_named("members", "wide", "met")
    links = links.unionByName(_verified(second, nodes, texts, scratch))
    root = components(links, scratch).select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return own.join(root, "__node", "left").select(*docs.columns, "__row", F.coalesce("__root", "__node").alias("__component"))
