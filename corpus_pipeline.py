"""Corpus pipeline over documents: quality, near-duplicates, benchmark passages, secrets, pieces.

Each stage takes what its predecessor kept and returns the columns of documents; the last adds
pieces and n_pieces. SQL cannot express the stages, so ORACLE_SQL is None and the tests hold run()
against a brute-force version.

Null and empty texts have no words, so the first stage rejects them. Rows of a null id, or of one id and
other texts, are each judged by their text; of rows alike in id and text one stays. An empty table gives an
empty result, and texts are taken whole, however long. Other columns stay as they are, whatever their
names; only pieces and n_pieces are replaced by the last stage, and n_chars is counted anew where a text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import decontaminate, near_dup, pieces, quality, secrets
from tidewright.llm.common import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep; null and empty texts are none of them."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id (one without an id if none has one)."""
    return near_dup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents into whose own text no benchmark item leaked; null items leak nothing."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars counted anew where a text changed; null texts stay null."""
    scanned = docs.withColumn("__tw_scan", secrets.scan_column(F.col("text")))
    found = F.size("__tw_scan.spans") > 0
    text = F.when(found, F.col("__tw_scan.redacted")).otherwise(F.col("text"))
    scanned = scanned.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        scanned = scanned.withColumn("n_chars", F.when(found, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return scanned.select(*docs.columns)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the ids of their pieces; null texts have null ones."""
    return pieces.encode_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("near-dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("sentencepiece", pieces_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir, one after the other."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
