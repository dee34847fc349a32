"""Known words: statuses, filters and updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.schemas import require_columns

#: Statuses whose words are left out.
EXCLUDED = ("known", "ignore")
KEYS = ("lemma", "synset_id", "item_type")


def normalized(words: DataFrame, order: str) -> DataFrame:
    """Lower-cased known words, of each key the last row by ``order``; sense ids and empty tags are kept."""
    require_columns(words, ["lemma", "status", "item_type", "tags"], "known words")
    sense = F.coalesce("synset_id", F.lit("")) if "synset_id" in words.columns else F.lit("")
    plain = words.select(
        F.lower(F.trim("lemma")).alias("lemma"),
        F.lower(F.trim("status")).alias("status"),
        F.lower(F.trim("item_type")).alias("item_type"),
        F.coalesce("tags", F.lit("")).alias("tags"),
        sense.alias("synset_id"),
        F.col(order).alias("__order"),
    )
    last = Window.partitionBy(*KEYS).orderBy(F.desc("__order"))
    return plain.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__order")


def by_status(candidates: DataFrame, known: DataFrame, exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Candidates left-joined to known words by lemma, without those of an excluded status.

    A lemma known several times comes out once for each status that is not excluded.
    """
    status = known.select("lemma", F.lower("status").alias("__status"))
    joined = candidates.join(status, "lemma", "left")
    return joined.where(~F.coalesce("__status", F.lit("")).isin(*exclude)).drop("__status")


def unknown_phrases(stats: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """Phrases of a least frequency that are not known words, whatever their status."""
    words = known.select(F.lower("lemma").alias("__phrase")).distinct()
    enough = stats.where(F.col("book_freq") >= max(least, 1))
    return enough.join(words, F.lower("phrasal") == F.col("__phrase"), "left_anti")


def upsert(known: DataFrame, updates: DataFrame) -> DataFrame:
    """``known`` with the rows of ``updates`` in place of those of equal lemma and item type."""
    kept = known.join(updates.select("lemma", "item_type").distinct(), ["lemma", "item_type"], "left_anti")
    return kept.select(*known.columns).unionByName(updates)


def progress(known: DataFrame) -> DataFrame:
    """Rows by status."""
    return known.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
