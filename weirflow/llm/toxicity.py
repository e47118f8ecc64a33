"""Toxicity by multiple-instance learning.

A text is a bag of sentences. A sentence's share in the score is by how much a logistic model of its words and their
beginnings exceeds that of a plain sentence, without weighted features, and never below 0; a text's probability is the noisy-or of
its shares and of one leak, however many plain sentences it has. Only texts have labels: the noisy-or's gradient shares a text's
label out over its sentences, so the fitted model also tells which sentence offends.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.shared import small_batches, trim

#: Labelled texts that the model is fitted on, at most; taken by the hash of their ids.
FIT_ROWS = 4000
#: Characters of texts that the model is fitted on, at most.
FIT_CHARS = 40_000_000
#: A word is a feature if so many texts of the sample hold it.
MIN_TEXTS = 5
#: Weight of the sum of absolute word weights in the loss, in units of a text's log loss, when features are picked, and when these are fitted again.
SPARSITY, RELAXED = 0.6, 0.02
#: Lengths of the word beginnings that are features too.
PREFIXES = (3, 4, 5)
#: Features kept by the screening, at most.
MOST_FEATURES = 1500
#: The bias of a sentence, and so of a text's leak.
MOST_BIAS = -6.0
THRESHOLD = 0.7
_ROUNDS = 300

_SENTENCE = re.compile(r"[.!?。！？]+\s+|\n+")
_EDGE = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>*#$%&|«»„“”‘’-–—_/\\"


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if s and not s.isspace()]


def features(token: str) -> list[str]:
    """A lower-case token's features: the word without marks at its ends, and its first letters."""
    w = token.strip(_EDGE)
    return [w, *(f"{w[:k]}*" for k in PREFIXES if len(w) > k)] if w else []


@dataclass
class NoisyOr:
    """Feature weights and bias of the sentence model."""

    bias: float = -6.0
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self._starts = {f.rstrip("*")[:3] for f in self.weights}

    def weight(self, token: str) -> float:
        """Sum of the weights of a lower-case token's features."""
        return sum(self.weights.get(x, 0.0) for x in features(token))

    def sentence_scores(self, text: str | None) -> list[tuple[str, float]]:
        """Every sentence with its probability; 0 for plain ones."""
        return [(s, -math.expm1(-self.share(sum(map(self.weight, set(s.lower().split())))))) for s in sentences(text)]

    def share(self, z: float) -> float:
        """What a sentence with the sum of weights ``z`` adds to the noisy-or: its excess over a plain sentence."""
        if z <= 0:
            return 0.0
        return max(self.bias + z, 0) + math.log1p(math.exp(-abs(self.bias + z))) - math.log1p(math.exp(self.bias))

    def score(self, text: str | None) -> float:
        """The noisy-or of the leak and all sentences; 0 for a text without any."""
        low = (text or "").lower()
        found = sentences(low)
        if not found:
            return 0.0
        starts = self._starts
        words = {t.strip(_EDGE) for t in set(low.split())}
        telling = {t: w for t in words if t[:3] in starts and (w := self.weight(t))}
        total = math.log1p(math.exp(self.bias))
        for s in found if telling else ():
            total += self.share(sum(telling.get(t.strip(_EDGE), 0.0) for t in set(s.split())))
        return -math.expm1(-total)


def fit(texts: list[str | None], labels: list[int], min_texts: int = MIN_TEXTS, sparsity: float = SPARSITY, relaxed: float = RELAXED, rounds: int = _ROUNDS, most: int = MOST_FEATURES) -> NoisyOr:
    """Maximum likelihood of the labels under the noisy-or, by proximal AdaGrad, in two steps.

    Features are screened first: the ``most`` whose presence in texts parts the labels best by the chi-square statistic. The first step
    has an L1 penalty and picks features; the second fits those of positive weight again, with next to none. A text may be
    labelled toxic by mistake: the fit has a share of such labels as a parameter, which the score leaves out. A group
    of copies counts once: rows of equal texts and labels are one.
    """
    number: dict[str, int] = {}
    tokens, sizes, text_of, y, seen = [], [], [], [], set()
    for text, label in zip(texts, labels, strict=True):
        found = sentences(text)
        if not found or (key := (xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")), label)) in seen:
            continue
        seen.add(key)
        for s in found:
            own = set(s.lower().split())
            tokens.append(np.fromiter((number.setdefault(t, len(number)) for t in own), np.int32, len(own)))
            sizes.append(len(own))
            text_of.append(len(y))
        y.append(label)
    if not 0 < sum(y) < len(y):
        return NoisyOr()
    # by numbers: the tokens of all sentences, the features of all tokens by hash (0: none), a column for the word and each length of beginnings
    token, y = np.concatenate(tokens), np.array(y)
    del tokens
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    text_of, names = np.array(text_of), list(number)
    width = 1 + len(PREFIXES)
    hashes = np.zeros((width, len(names)), np.uint64)
    for i, t in enumerate(names):
        for j, f in enumerate(features(t)):
            hashes[j, i] = xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass")) or 1
    pairs = np.unique(text_of[sentence].astype(np.int64) * len(names) + token)
    found = []
    for j in range(width):
        known, first, of_token = np.unique(hashes[j], return_index=True, return_inverse=True)
        held = np.unique(pairs // len(names) * len(known) + of_token[pairs % len(names)])
        n = np.bincount(held % len(known), minlength=len(known)).astype(float)
        b = np.bincount(held % len(known), y[held // len(known)], len(known))
        parting = (b * len(y) - n * y.sum()) ** 2 / (n * np.maximum(len(y) - n, 0.5))
        on = np.flatnonzero((n >= min_texts) & (known != 0))
        found.append((parting[on], known[on], first[on], np.full(len(on), j)))
    parting, known, first, column = (np.concatenate(x) for x in zip(*found, strict=True))
    best = np.lexsort((known, -parting))[:most]

    def solved(chosen: np.ndarray, sparsity: float, rounds: int) -> np.ndarray:
        feature, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j in range(width):
            own = np.flatnonzero(column[chosen] == j)
            if len(own):
                own = own[np.argsort(known[chosen[own]])]
                at = np.minimum(np.searchsorted(known[chosen[own]], hashes[j]), len(own) - 1)
                place = np.where(known[chosen[own]][at] == hashes[j], own[at], -1)[token]
                feature.append(place[place >= 0])
                of.append(sentence[place >= 0])
        feature, of = np.concatenate(feature), np.concatenate(of)
        used, of = np.unique(of, return_inverse=True)
        return _weights(feature, of, text_of[used], y.astype(float), len(chosen), sparsity, rounds)

    picked = best[solved(best, sparsity, rounds) > 0]
    weights = solved(picked, relaxed, 2 * rounds)
    return NoisyOr(MOST_BIAS, {features(names[first[f]])[column[f]]: float(w) for f, w in zip(picked, weights, strict=True) if w})


def _weights(feature: np.ndarray, of_sentence: np.ndarray, of_text: np.ndarray, y: np.ndarray, n: int, sparsity: float, rounds: int) -> np.ndarray:
    """The weights of ``n`` features; ``feature`` occurs in the sentences ``of_sentence``, which are in the texts ``of_text``."""
    theta, seen_g = np.zeros(n), np.full(n, 1.0)
    if not len(feature):
        return theta
    wrong, seen_w = -3.0, 1.0
    plain = np.logaddexp(0, MOST_BIAS)
    for _ in range(rounds):
        z = np.bincount(of_sentence, theta[feature], len(of_text))
        on = z >= 0
        total = np.logaddexp(0, wrong) + np.bincount(of_text, np.where(on, np.logaddexp(0, MOST_BIAS + z) - plain, 0), len(y))
        # d loss / d total: 1 for clean texts, -q / (1 - q) for toxic ones, q = exp(-total)
        slope = np.where(y > 0, -1 / np.expm1(np.clip(total, 1e-4, 700)), 1.0)
        g = np.where(on, slope[of_text] / (1 + np.exp(-(MOST_BIAS + z))), 0)
        grad = np.bincount(feature, g[of_sentence], n)
        g_wrong = slope.sum() / (1 + np.exp(-wrong))
        seen_g += grad**2
        seen_w += g_wrong**2
        step = 1.5 / np.sqrt(seen_g)
        theta -= step * grad
        theta = np.sign(theta) * np.maximum(np.abs(theta) - step * sparsity, 0)
        wrong -= 1.5 / np.sqrt(seen_w) * g_wrong
    return theta


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> NoisyOr:
    """Fit on at most ``rows`` labelled rows and ``chars`` characters, those with the least hash of their id.

    A text that is longer than what is left of the characters is passed over, and shorter ones after it are taken. Rows whose id is
    held out are not looked at; NULL labels and ids are not either.
    """
    i = F.col(f"`{id_col}`").cast("string")
    own = labels.where(F.col(f"`{label_col}`").isNotNull() & (F.crc32(i.cast("binary")) % 3 != 1))
    own = own.select(i.alias("__id"), F.col(f"`{label_col}`").cast("int").alias("__label")).groupBy("__id").agg(F.max("__label").alias("__label"))
    chosen = own.orderBy(F.xxhash64("__id"), "__id").limit(rows)
    texts = df.select(i.alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    found, size = [], 0
    for r in texts.join(F.broadcast(chosen), "__id").orderBy(F.xxhash64("__id"), "__text").toLocalIterator():
        if size + len(r["__text"] or "") <= chars:
            size += len(r["__text"] or "")
            found.append((r["__text"], r["__label"]))
    own, marks = [t for t, _ in found], [y for _, y in found]
    del found
    model = fit(own, marks)
    own.clear()
    trim()
    return model


def scored(df: DataFrame, model: NoisyOr, text_col: str = "text") -> DataFrame:
    """``df`` with a column ``__toxicity``, the probability of each whole text; one row per row.

    NULL, empty and wordless texts score 0. Nothing but the text is an input.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in texts:
            yield pd.Series([model.score(t) for t in x], dtype="float64")

    return df.withColumn("__toxicity", score(F.col(f"`{text_col}`").cast("string")))


def offending(df: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """``(id_col, place, sentence, score)`` of the sentences that offend, place counted from 0."""
    small_batches(df.sparkSession)
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, i, s, p) for k, t in enumerate(b.column(1).to_pylist()) for i, (s, p) in enumerate(model.sentence_scores(t)) if p >= at_least]
            at = pa.array([r[0] for r in rows], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.float64())], names=[id_col, "place", "sentence", "score"])

    return df.select(f"`{id_col}`", F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, place int, sentence string, score double")


def held_out(doc_id: object) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document. A NULL id is not held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels)
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), F.col("__toxicity").alias("score"), (F.col("__toxicity") >= THRESHOLD).cast("int").alias("predicted"))
