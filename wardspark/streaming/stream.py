"""Structured Streaming: the column verbs are stateless, so they stream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspark.engine import Engine


def analyze_stream(stream: DataFrame, engine: Engine, text: str = "text") -> DataFrame:
    return engine.analyze(stream, text)


def toxicity_per_window(
    stream: DataFrame, engine: Engine, time: str, keys: list[str], text: str = "text", window: str = "5 minutes", late: str = "10 minutes"
) -> DataFrame:
    """Extension: counts of texts and toxic texts per key and tumbling window, with a watermark."""
    flagged = stream.withWatermark(time, late).withColumn("_toxic", engine.is_toxic_column(F.col(text)))
    return (
        flagged.groupBy(F.window(time, window), *keys)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("_toxic", F.lit(False))).alias("n_toxic"))
        .select(F.col("window.start").alias("window_start"), *keys, "n", "n_toxic")
    )
