"""Word senses: choice by similarity, and statistics by category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.scores import combined, cosine
from glossmill.schemas import require_columns


def sense_statistics(annotated: DataFrame) -> DataFrame:
    """Per lemma and category: frequency, sentences, share, number of categories and the leading one."""
    require_columns(annotated, ["lemma", "supersense", "sentence_id"], "annotated")
    rows = annotated.where("lemma is not null and supersense is not null")
    one = rows.groupBy("lemma", "supersense").agg(
        F.count(F.lit(1)).alias("sense_freq"), F.count_distinct("sentence_id").alias("doc_count")
    )
    every = Window.partitionBy("lemma")
    best = every.orderBy(F.desc("sense_freq"), "supersense")
    return (
        one.withColumn("book_freq", F.sum("sense_freq").over(every))
        .withColumn("sense_ratio", F.col("sense_freq") / F.col("book_freq"))
        .withColumn("sense_count", F.count(F.lit(1)).over(every))
        .withColumn("dominant_supersense", F.first("supersense").over(best))
    )


def candidates(items: DataFrame, senses: DataFrame) -> DataFrame:
    """Items (lemma, pos, ..) with their senses; those without any of their pos take all of the lemma."""
    exact = items.join(senses.withColumnRenamed("pos", "__pos"), "lemma").where("pos = __pos").drop("__pos")
    rest = items.join(senses.select("lemma", "pos").distinct(), ["lemma", "pos"], "left_anti")
    return exact.unionByName(rest.join(senses.drop("pos"), "lemma"))


def choose(pairs: DataFrame, item: str, weight: float = 0.0) -> DataFrame:
    """(item, synset_id, confidence): the best of each item's senses; the first in rank wins ties.

    ``pairs`` has item, synset_id, rank, query and gloss (vectors), and boost if
    ``weight`` is not 0.  Without a positive score the sense is null.
    """
    score = cosine(F.col("query"), F.col("gloss"))
    if weight:
        score = combined(score, F.col("boost"), weight)
    best = pairs.groupBy(item).agg(
        F.max(F.struct(score.alias("score"), (-F.col("rank")).alias("rank"), "synset_id")).alias("best")
    )
    good = F.col("best.score") > 0
    return best.select(
        item,
        F.when(good, F.col("best.synset_id")).alias("synset_id"),
        F.when(good, F.col("best.score")).otherwise(F.lit(0.0)).alias("confidence"),
    )


def choose_guided(
    pairs: DataFrame, guidance: DataFrame, item: str, weight: float = 0.0, applied: tuple[str, ...] = ("SKIP",)
) -> DataFrame:
    """(item, synset_id, sense_label, confidence, construction_tag): the best sense of each item under its construction.

    ``pairs`` has item, synset_id, supersense, rank, query and gloss, and boost if
    ``weight`` is not 0; ``guidance`` is that of ``constructions.guidance``, a row
    an item at most.  A construction is always told; what it does to the choice
    is limited to the policies ``applied``, by default SKIP alone:

    * SKIP: no candidate stays; the label is ``construction``.
    * CONSTRAIN: candidates of forbidden categories are left out; of equal scores
      a preferred sense or category wins.
    * OVERRIDE: the first of its senses that is a candidate wins whatever its
      score, and if none is, they are preferred as by CONSTRAIN.

    Without a candidate or a positive score the sense is null and the label
    ``unknown``.  All is decided within one aggregation by item; items without
    guidance are chosen as ``choose`` does.
    """
    score = cosine(F.col("query"), F.col("gloss"))
    if weight:
        score = combined(score, F.col("boost"), weight)
    rules = guidance.select(item, "construction", "policy", "forbid_supersenses", "prefer_synsets", "prefer_supersenses")
    rows = pairs.join(rules, item, "left").withColumn("__policy", F.when(F.col("policy").isin(*applied), F.col("policy")))

    def among(value: str, listed: str):
        return F.coalesce(F.array_contains(listed, F.col(value)), F.lit(False))

    guided = F.coalesce(F.col("__policy").isin("CONSTRAIN", "OVERRIDE"), F.lit(False))
    skipped = F.coalesce(F.col("__policy") == "SKIP", F.lit(False))
    forbidden = F.coalesce(F.col("__policy") == "CONSTRAIN", F.lit(False)) & among("supersense", "forbid_supersenses")
    at = F.array_position("prefer_synsets", F.col("synset_id"))
    forced = F.when((F.col("__policy") == "OVERRIDE") & (at > 0), F.size("prefer_synsets") - at + 1).otherwise(F.lit(0))
    liked = guided & (among("synset_id", "prefer_synsets") | among("supersense", "prefer_supersenses"))
    order = F.struct(
        forced.alias("forced"), score.alias("score"), liked.cast("int").alias("liked"), (-F.col("rank")).alias("rank"), "synset_id", "supersense"
    )
    best = rows.groupBy(item).agg(
        F.max(F.when(~skipped & ~forbidden, order)).alias("best"), F.first("construction").alias("construction_tag"), F.max(skipped).alias("skipped")
    )
    good = F.coalesce((F.col("best.score") > 0) | (F.col("best.forced") > 0), F.lit(False))
    return best.select(
        item,
        F.when(good, F.col("best.synset_id")).alias("synset_id"),
        F.when(F.col("skipped"), "construction").when(good, F.col("best.supersense")).otherwise("unknown").alias("sense_label"),
        F.when(good, F.greatest("best.score", F.lit(0.0))).otherwise(F.lit(0.0)).alias("confidence"),
        "construction_tag",
    )


def smart_candidates(scored: DataFrame, item: str, most: int = 15) -> DataFrame:
    """Senses worth showing: the first 60 % of places by score, then new categories, then boosted ones.

    ``scored`` has item, synset_id, lexname, score and boost.
    """
    n_top = max(1, int(most * 0.6))
    by = Window.partitionBy(item).orderBy(F.desc("score"), "synset_id")
    placed = scored.withColumn("__r", F.row_number().over(by)).withColumn("__top", F.col("__r") <= n_top)
    in_category = Window.partitionBy(item, "lexname")
    seen = F.max(F.col("__top").cast("int")).over(in_category) == 1
    first = F.row_number().over(in_category.orderBy("__r")) == 1
    reason = (
        F.when(F.col("__top"), "top_score").when(~seen & first, "new_category").when(F.col("boost") > 0.05, "context")
    )
    order = F.when(F.col("reason") == "top_score", 0).when(F.col("reason") == "new_category", 1).otherwise(2)
    kept = placed.withColumn("reason", reason).where("reason is not null")
    final = Window.partitionBy(item).orderBy(order, "__r")
    return kept.withColumn("place", F.row_number().over(final)).where(F.col("place") <= most).drop("__r", "__top")
