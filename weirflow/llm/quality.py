"""Quality rules as weak supervision, in DataFrame expressions only.

Each rule votes good (+1), votes bad (-1) or abstains (0). How often each pattern of votes occurs is counted
over all texts; expectation-maximisation over these counts estimates every rule's accuracy and the share of
good texts, and a text's posterior quality probability decides. There are at most 3 ** len(RULES)
patterns whatever the number of texts, so the counts are what goes to the driver.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.shared import SPACE, Scratch, text_column

SPACES = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: Frequent short words of the languages at hand.
FUNCTION_WORDS = "the of and to is that it for as with de la le et les des en un que el los y der die und das mit ein zu in du est ist den".split()
#: (name, bad if, good if): votes on the columns of measured(); the first that holds counts, else the rule abstains. Variety is Herdan's
#: measure, whose bound is one for texts of all lengths.
RULES: tuple[tuple[str, str, str], ...] = (
    ("word_length", "word_chars < 2.6 * n_words or word_chars > 6.9 * n_words", "false"),
    ("symbols", "10 * n_symbols > n_words", "false"),
    ("lines", "10 * n_dup_lines > 4 * n_lines", "false"),
    ("repeats", "100 * n_repeat_words > 50 * n_words", "false"),
    ("variety", "n_words > 1 and ln(n_distinct) < 0.85 * ln(n_words)", "false"),
    ("endings", "5 * n_ended < n_lines", "5 * n_ended >= 4 * n_lines"),
    ("capitals", "5 * n_capitals > word_chars", "false"),
    ("function_words", "25 * n_function < n_words", "8 * n_function >= n_words"),
)
ROUNDS = 60
#: What is held of a rule before any text is seen: the share of bad and of good texts that it calls bad, of those
#: where it could vote at all; and how many texts that belief is worth, as a share of all.
FINDS, ERRS, PRIOR_WEIGHT = 0.5, 0.01, 0.02
#: The share of good texts that is held before any is seen.
GOOD = 0.85


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ...)`` per row.

    Words are ``[^\\x20\\x09-\\x0D]+``. NULL has no words. Repeated words are found inside the row, by sorting
    the hashes of its windows where some hash occurs twice, so no row is spread over tasks and memory
    and time are in proportion to the text.
    """
    text = F.coalesce(text_column(df, text_col).cast("string"), F.lit(""))
    base = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"))
    trimmed = F.btrim("t", F.lit(SPACE))
    base = base.select("id", "t", F.when(trimmed != "", F.split(trimmed, SPACES)).otherwise(F.expr("cast(array() as array<string>)")).alias("w"), F.split("t", "\n").alias("l0"))
    base = base.select(
        "id", "t", "w", F.filter("l0", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
        F.expr(f"case when size(w) >= {WINDOW} then transform(sequence(1, size(w) - {WINDOW - 1}), i -> xxhash64(slice(w, i, {WINDOW}))) else cast(array() as array<bigint>) end").alias("h"),
    )
    several = base.select("*", F.expr("size(array_distinct(h)) < size(h)").alias("several"))
    runs = several.select("*", F.expr("case when several then sort_array(transform(h, (x, i) -> struct(x as x, i as i))) else cast(array() as array<struct<x: bigint, i: int>>) end").alias("s")).drop("h", "several")
    at = runs.select("*", F.expr("sort_array(transform(filter(s, (e, i) -> (i > 0 and s[if(i > 0, i - 1, 0)].x = e.x) or (i + 1 < size(s) and s[if(i + 1 < size(s), i + 1, i)].x = e.x)), e -> e.i))").alias("p")).drop("s")
    covered = f"aggregate(transform(p, (e, k) -> if(k + 1 < size(p), least({WINDOW}, p[if(k + 1 < size(p), k + 1, k)] - e), {WINDOW})), 0L, (a, x) -> a + x)"
    joined = at.select("*", F.array_join("w", "").alias("j"))
    return joined.select(
        F.col("id").alias(id_col),
        F.size("w").cast("long").alias("n_words"),
        F.char_length("j").cast("long").alias("word_chars"),
        F.regexp_count("j", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        F.size("l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.size(F.filter("l", lambda x: x.rlike(r"[.!?。！？:;\"')\]]\s*$"))).cast("long").alias("n_ended"),
        F.regexp_count("j", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(FUNCTION_WORDS))).cast("long").alias("n_function"),
    )


def votes() -> list[Column]:
    return [F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end").cast("int").alias(f"vote_{name}") for name, bad, good in RULES]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> list[float]:
    """Log-odds of a good text: first the base, then per rule what a good, a bad and no vote add.

    ``patterns`` are votes with their counts. Every rule has, per class, its own chances of the three
    outcomes; they start from, and are drawn to, a rule that is mostly right.
    """
    k = len(RULES)
    total = sum(n for _, n in patterns) or 1
    outcomes = (1, -1, 0)
    seen = [{o: sum(n for p, n in patterns if p[j] == o) / total for o in outcomes} for j in range(k)]
    start = []
    for j in range(k):
        good = {-1: ERRS, 1: (1 - ERRS) * seen[j][1], 0: (1 - ERRS) * (1 - seen[j][1])}
        bad = {-1: FINDS, 1: (1 - FINDS) * seen[j][1] / 2, 0: (1 - FINDS) * (1 - seen[j][1] / 2)}
        start.append((good, bad))
    share, chance = GOOD, start
    weight = PRIOR_WEIGHT * total + 1

    def odds(p):
        return math.log(share / (1 - share)) + sum(math.log(max(chance[j][0][p[j]], 1e-9) / max(chance[j][1][p[j]], 1e-9)) for j in range(k))

    for _ in range(rounds):
        soft = [(p, n, 1 / (1 + math.exp(-max(-60.0, min(60.0, odds(p)))))) for p, n in patterns]
        good_n = sum(n * q for _, n, q in soft)
        share = min(max((good_n + GOOD * weight) / (total + weight), 0.01), 0.99)
        fresh = []
        for j in range(k):
            good, bad = {}, {}
            for o in outcomes:
                good[o] = (sum(n * q for p, n, q in soft if p[j] == o) + weight * start[j][0][o]) / (good_n + weight)
                bad[o] = (sum(n * (1 - q) for p, n, q in soft if p[j] == o) + weight * start[j][1][o]) / (total - good_n + weight)
            fresh.append((good, bad))
        chance = fresh
    out = [math.log(share / (1 - share))]
    for good, bad in chance:
        out += [math.log(max(good[o], 1e-9) / max(bad[o], 1e-9)) for o in outcomes]
    return out


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Measures, votes, ``probability`` (posterior that the text is good), ``base_failed`` and ``kept``, per row.

    A text that fails the base test (fewer than 10 words, or over a fifth of them in repeated windows) is not
    kept; others are if their probability is at least a half. NULL and empty texts have no words and fail;
    repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
    """
    scratch = scratch or Scratch(df.sparkSession, "quality")
    own = scratch.stage(measured(df, id_col, text_col).select("*", *votes()), "votes")
    names = [f"vote_{name}" for name, _, _ in RULES]
    counts = own.groupBy(*names).count().collect()
    model = fit([(tuple(r[n] for n in names), r["count"]) for r in counts])
    parts = [F.lit(model[0])]
    for j, n in enumerate(names):
        good, bad, none = model[1 + 3 * j : 4 + 3 * j]
        parts.append(F.when(F.col(n) > 0, good).when(F.col(n) < 0, bad).otherwise(none))
    odds = reduce(lambda a, b: a + b, parts)
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    out = own.select("*", (1 / (1 + F.exp(-odds))).alias("probability"), failed.alias("base_failed"))
    return out.select("*", (~F.col("base_failed") & (F.col("probability") >= 0.5)).alias("kept"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
