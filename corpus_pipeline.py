"""A training corpus from raw documents: five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import bpe, decontaminate, similar, substrings, toxicity
from weirflow.llm.shared import Scratch, forget

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents; other columns go."""
    return docs.select(*COLUMNS)


#: What stages have staged, by folder of tables.
_STAGED: dict[str, Scratch] = {}


def _fresh(spark: SparkSession, sf_dir: str, name: str) -> Scratch:
    """Where a stage stages its tables. Those of the stage before go: its result has been written when the next one begins."""
    before = _STAGED.pop(sf_dir, None)
    if before:
        before.drop_all()
    forget(spark)
    _STAGED[sf_dir] = Scratch(spark, name)
    return _STAGED[sf_dir]


def _numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """The columns of documents and ``__row``, a number of its own for each row, staged so that it stays the row's; ids may be NULL or repeat."""
    return scratch.stage(_columns(docs).withColumn("__row", F.monotonically_increasing_id()), "rows")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold stay; the model is fitted on labelled ones of ``docs``.

    NULL and empty texts have none and stay; repeated rows and equal ids are judged each by its text; without labels of both kinds all
    stay; an empty table gives an empty one. As in all stages, columns that documents do not have go, and very long texts are judged whole.
    """
    _fresh(spark, sf_dir, "toxicity")
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(toxicity.scored(_columns(docs), model).where(F.col("__toxicity") < toxicity.THRESHOLD))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (5-word shingles, similarity 0.8 or more) the row with the least id and row number stays, one without an id only if there is no other.

    Texts without words are alike, so one of them stays; copies are one component; an empty table gives an empty one.
    """
    found = similar.near_duplicates(_columns(docs), _fresh(spark, sf_dir, "similar"))
    least = found.groupBy("__component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("least"))
    return _columns(found.join(least.select(F.col("least.__row").alias("__row")), "__row", "left_semi"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat go. A document that loses words has the rest joined by one space; one that loses all goes.

    NULL and wordless texts lose nothing and stay as they are; rows with equal ids or none are told apart; an empty table gives an empty one.
    """
    scratch = _fresh(spark, sf_dir, "substrings")
    docs = _numbered(scratch, docs)
    found = substrings.deduplicated(docs, id_col="__row", scratch=scratch)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    joined = docs.join(found, "__row").where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return _columns(joined.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go.

    NULL and wordless texts hold none; rows with equal ids or none are told apart; with an empty benchmark all stay; an empty table gives an empty one.
    """
    scratch = _fresh(spark, sf_dir, "decontaminate")
    docs = _numbered(scratch, docs)
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="__row", scratch=scratch)
    return _columns(docs.join(found.where("contaminated").select("__row"), "__row", "left_anti"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, as digests, with what they decode to. NULL and empty texts have none; rows with equal ids or none are encoded each; an empty table gives an empty one."""
    import public_tokenizers as tokenizers

    return bpe.encode_digests(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN, scratch=_fresh(spark, sf_dir, "bpe"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL can express neither the fitted model nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return docs
