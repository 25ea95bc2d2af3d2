"""From documents to token files, in five stages.

Each stage takes the documents that the one before kept, decides over all of
them, and returns the kept ones with the columns of ``documents``; the last
returns the token table. Stages are written as Parquet and read again, so each
starts from a table, whatever happened to executors before.

Labels and the benchmark are read from ``sf_dir``. What SQL cannot express (a
fitted model, latent vectors) is tested against brute force in tests/llm.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows
and columns of any name, which it hands on as they are; an empty table gives an empty
one. Stages that go by ids keep or drop the rows of one id together, null ids too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardspark.llm import common, decontam, mixing, near_dups, quality, token_codes


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its threshold or above; all, if no labels of both classes are there to fit it."""
    return quality.keep_good(docs, common.table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of texts of similarity 0.8 or more; texts without words are one class."""
    return near_dups.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; all, if that is empty."""
    return decontam.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with probabilities raked to the target marginals; those without words are kept."""
    return mixing.keep_selected(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the kept documents, in order of id; their table (doc_id, start, n_tokens, ids_crc32) as read back."""
    folder = common.work_dir(spark, "tokens")
    return token_codes.read(token_codes.write(docs, folder, token_codes.vocabulary()), folder)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    folder = common.work_dir(spark, "pipeline")
    for n, (name, stage) in enumerate(STAGES):
        docs = common.saved(stage(spark, docs, sf_dir), f"{folder}/{n}-{name}")
    return docs
