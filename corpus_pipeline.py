"""The corpus pipeline: quality rules, SimHash near-dedup, secret scans, mixing
to target weights and best-fit packing, each stage over all that its
predecessor kept.

A stage is a function of (spark, docs, sf_dir); ``run`` writes each result as
Parquet to the session's shared folder and hands it, read back, to the next.
All stages but the last return the columns of ``documents``; the last returns
one row per packed piece."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from speechtab.llm import common, mixing, packing, quality, secrets, simhash
from speechtab.llm.queries import MIX, tokenizer_path

#: The production mix without a second epoch: what is deduplicated stays so.
ONE_EPOCH = replace(MIX, epochs=1, share=0.9)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that meet every threshold; the rest go."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents within four fingerprint bits, the one with
    the smallest id."""
    return simhash.keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets masked."""
    return secrets.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their source's share of the token budget."""
    return mixing.select(docs, ONE_EPOCH, epoch_col=None)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a training sequence."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", mixed_sources),
    ("best-fit packing", best_fit_packing),
]

#: Fingerprints (XXH64) and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
