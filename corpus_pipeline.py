"""The corpus pipeline: quality rules, exact dedup, near-dedup, secret scans, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from terrafield.llm import exact_dedup, near_dedup, packing, quality, secrets
from terrafield.session import cut_lineage, delete_tables, recorded_tables

#: Tables that the stage before wrote on its way; its result has been written too when the next stage is called.
_before: list[str] = []


def _stage(f):
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete_tables(spark, _before)
        with recorded_tables() as made:
            out = f(spark, docs, sf_dir)
        _before.extend(made)
        return out

    return run


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; found spans are replaced in its text, and ``n_chars`` follows."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)


STAGES = [
    ("quality_rules", _stage(good_documents)),
    ("exact_dedup", _stage(without_copies)),
    ("near_dedup", _stage(without_near_copies)),
    ("secret_scans", _stage(without_secrets)),
    ("best_fit_packing", _stage(packed)),
]

#: Near links and the packing are beyond a SQL statement; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    out = STAGES[-1][1](spark, docs, sf_dir)
    _before.clear()  # ``out`` reads the last stage's tables
    return out
