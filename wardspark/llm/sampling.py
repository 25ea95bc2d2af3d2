"""Labelled rows for fitting: at most a stated number, picked by a hash of their id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardspark.llm import common


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, where: Column | None = None) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled ids, the first by hash.

    The ids have a proven bound, ``most`` rows, and are broadcast. Of several labels
    of one id the smallest counts, of several texts of one id the smallest by its
    bytes; null ids and labels are no labels.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    if where is not None:
        known = known.filter(where)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return common.texts(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def gathered(sample: DataFrame, features: Callable, schema: str) -> list:
    """Feature rows of a bounded sample, on the driver, in id order."""
    return sorted(sample.mapInArrow(features, schema).collect(), key=lambda r: r.doc_id)
