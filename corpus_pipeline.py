"""Corpus pipeline: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns the documents it keeps with their columns, the last one the token
ids. A stage's result is written as Parquet and read again as the next one's input. Rows with a null text or id pass
through as the operators define; an empty table gives empty tables.

The result can't be put in SQL (fitted classifier, MinHash, XXH64, BPE), so ORACLE_SQL is None and the stages are tested
against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import byte_bpe, decontaminate, line_dedup, simhash, weak_labels
from quillspark.llm.common import documents, saved
from quillspark.sources.tables import read_table

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier, fitted on this input, keeps."""
    return weak_labels.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat others; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.keep_one(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded_sha256``: the token ids and the digest of what they decode to."""
    # saved in between, so that an executor doesn't hold the workers of both at once
    both = byte_bpe.decode(saved(byte_bpe.encode(docs.select("doc_id", "text")).drop("text"), "token-ids"))
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_free),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
