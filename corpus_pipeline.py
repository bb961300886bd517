"""Corpus pipeline: quality rules, near duplicates, secrets, mixing, token ids.

``run(spark, sf_dir)`` applies STAGES in order to the documents table. Each
stage is written as Parquet in the session's shared folder and read again by
the next one, so a lost executor never costs more than one stage. A stage works
on all rows its predecessor kept; all but the last return the columns of
documents. The stages set the session's Arrow batches to TEXT_ROWS rows, as whole
texts go to Python: a batch lies in memory whole on both sides. ORACLE_SQL is None: compression ratios, the merge automaton and the
component search are not expressible in SQL (brute-force twin in tests/llm).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import bpe_automaton, curriculum, jaccard_join, quality_bands, secret_index
from basketlens.llm.common import BATCH_ROWS, read, saved
from basketlens.llm.queries import byte_bpe_path

TEXT_ROWS = 1000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the compression bands reject."""
    spark.conf.set(BATCH_ROWS, TEXT_ROWS)
    return quality_bands.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return jaccard_join.keep_one_per_group(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mask."""
    return secret_index.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in training order."""
    return curriculum.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row: (doc_id, n_tokens, ids, decoded_sha256)."""
    spark.conf.set(BATCH_ROWS, TEXT_ROWS)
    e = bpe_automaton.encode_decode(docs, byte_bpe_path())
    return e.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("secret_scan", secret_stage),
    ("curriculum_mix", mixing_stage),
    ("bpe_automaton", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
