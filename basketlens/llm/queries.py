"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm import (bpe_automaton, chat_collapse, curriculum, hard_negatives, jaccard_join, language_id, lattice_lm,
                            prefix_trie, quality_bands, run_merge, secret_index, spotsigs, wavelet)
from basketlens.llm.common import read, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bands.score(read(spark, sf_dir, "documents"))


@register
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.fuse(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


@register
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_index.report(read(spark, sf_dir, "documents"))


@register
def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_classes(read(spark, sf_dir, "documents"))


@register
def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = curriculum.plan(read(spark, sf_dir, "documents"))
    return p.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position", "position_2").orderBy("position", "doc_id")


@register
def op6_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score(read(spark, sf_dir, "documents"), piece_path())


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@register
def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(read(spark, sf_dir, "documents"))


@register
def op8_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_path(spark, "wavelet-shards")
    wavelet.write_shards(read(spark, sf_dir, "documents"), out, word_bpe_path())
    r = wavelet.read_shards(spark, out)
    return r.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register
def op9_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_collapse.collapse_and_render(read(spark, sf_dir, "conversations"))


ORACLE["op9_chat_collapse"] = chat_collapse.SQL


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register
def op10_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bpe_automaton.encode_decode(read(spark, sf_dir, "documents"), byte_bpe_path())
    return e.select("doc_id", "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.turn_rows(read(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.shared_heads(turns))


ORACLE["op11_prefix_trie"] = prefix_trie.SQL


@register
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"), "vec_id", "embedding", moved, F.col("id") % 100 == 0)


ORACLE["op12_hard_negatives"] = hard_negatives.SQL


@register
def op13_run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_merge.tree_merge(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE["op13_run_merge"] = run_merge.SQL
