"""Registered queries of this subpackage: name -> (build(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import ball_tree, byte_bpe, exact_dedup, host_reputation, line_dedup, near_dedup, packing, prefix_trie, quality, secrets, shards, token_files, tournament_packing, twins


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_read(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, f"ids-{uuid.uuid4().hex}")
    token_files.write_token_files(_read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_digests(spark, folder)


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(_read(spark, sf_dir, "documents"))


def op4_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_read(spark, sf_dir, "documents"))


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_read(spark, sf_dir, "documents")).drop("first")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.judge_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"))


def op8_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"), carry={"text_sha256": F.sha2("__norm", 256)})


def op10_secret_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(_read(spark, sf_dir, "documents"))


def op11_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tournament_packing.pack_freely(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, digest=True)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_read(spark, sf_dir, "conversations"))


def op13_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.rank_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": (op1_line_dedup, twins.LINE_DEDUP),
    "op2_token_files": (op2_token_files, None),
    "op3_feistel_shards": (op3_feistel_shards, twins.shard_sql()),
    "op4_robust_quality": (op4_robust_quality, quality.twin_sql()),
    "op5_hyperminhash": (op5_hyperminhash, None),
    "op6_byte_bpe": (op6_byte_bpe, None),
    "op7_host_reputation": (op7_host_reputation, twins.HOST_REPUTATION),
    "op8_best_two_fit": (op8_best_two_fit, None),
    "op9_exact_dedup": (op9_exact_dedup, twins.EXACT_DEDUP),
    "op10_secret_entropy": (op10_secret_entropy, twins.secret_sql()),
    "op11_tournament_packing": (op11_tournament_packing, None),
    "op12_prefix_trie": (op12_prefix_trie, twins.PREFIX_TRIE),
    "op13_ball_tree_search": (op13_ball_tree_search, twins.RANKED_SEARCH),
}
