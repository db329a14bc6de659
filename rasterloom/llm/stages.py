"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir), all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import dedup_lines, kept_text
from .minhash import near_duplicates
from .packing import pack, token_pieces
from .quality_rules import kept_documents
from .suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of documents, with another text."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, and from the others the lines that too many documents of their source hold."""
    return _with_text(kept_documents(docs.select(*COLUMNS)), F.col("text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; every document stays."""
    return _with_text(dedup_lines(docs.select(*COLUMNS)), kept_text(F.col("text"), F.col("keep_bitmap")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group of near copies stays (five-word shingles, similarity 0.8), as do documents without a doc_id."""
    docs = docs.select(*COLUMNS)
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi").select(*COLUMNS)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go from the texts; every document stays."""
    return _with_text(remove_repeats(docs.select(*COLUMNS)), F.col("text"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and place."""
    return pack(token_pieces(docs))
