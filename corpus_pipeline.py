"""A corpus from raw documents to packed sequences, in five stages of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import BATCH_ROWS, materialize, table
from docmill.llm.language import learn, predict
from docmill.llm.lines import deduplicate_lines
from docmill.llm.mixing import mix_sources
from docmill.llm.near import near_duplicates
from docmill.llm.packing import digest, pack_documents


def _short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those whose language is rejected: no letter, or text unlike any learned language."""
    _short_batches(spark)
    return predict(docs, learn(docs), keep=True)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat earlier ones; those that lose all they had go."""
    _short_batches(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    left = deduplicate_lines(docs, carry=others)
    left = left.where((F.col("n_removed") == 0) | F.regexp_like("text", F.lit(r"\S")))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return left.select(*[own.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, five words to a shingle, similarity 0.8."""
    _short_batches(spark)
    gone = near_duplicates(docs, words=5).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to target weights of their sources, in a global shuffle."""
    _short_batches(spark)
    return mix_sources(docs).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths."""
    import public_tokenizers

    _short_batches(spark)
    return digest(pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language", language), ("lines", lines), ("near", near), ("mixing", mixing), ("packing", packing)]

#: SQL can express neither the language models nor the fuzzy stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
