"""Running lemma counts over arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.operators.tokens import learnable, tokenize


def running_frequency(arrivals: DataFrame) -> DataFrame:
    """(lemma, book_freq) of a stream of documents; write it in update or complete mode."""
    return learnable(tokenize(arrivals)).groupBy("lemma").agg(F.count(F.lit(1)).alias("book_freq"))


def windowed_events(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type and window of time; later ones than ``late`` are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", size), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "value")
    )
