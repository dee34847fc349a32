"""Lemma statistics, filters and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill import lexicon
from glossmill.functions.scores import rarity
from glossmill.operators.tokens import learnable
from glossmill.schemas import require_columns
from glossmill.sources.shared import materialize


def _counts() -> list:
    verb = F.count_if((F.col("pos") == "VERB") & F.col("__own"))
    own = F.count_if("__own")
    return [
        own.alias("book_freq"),
        F.count_distinct(F.when(F.col("__own"), F.col("sentence_id"))).alias("doc_count"),
        verb.alias("verb_count"),
        (own - verb).alias("other_pos_count"),
        F.count_if(F.col("is_stop") & F.col("__own")).alias("stopword_count"),
    ]


def lemma_frequency(tokens: DataFrame, stop: bool = False, proper: bool = False, other: bool = False) -> DataFrame:
    """Per lemma: occurrences, sentences, verbs, others and stop words."""
    require_columns(tokens, ["lemma", "sentence_id", "is_stop", "pos", "is_alpha"], "tokens")
    # Names are not counted rather than left out: a filter on tags would make the rules run twice a token, in code too long to be compiled.
    own = F.lit(True) if proper else F.col("pos") != "PROPN"
    found = learnable(tokens, stop, True, other).withColumn("__own", own).groupBy("lemma").agg(*_counts())
    return found.where("book_freq > 0")


def lemma_frequency_with_zipf(tokens: DataFrame) -> DataFrame:
    """``lemma_frequency`` with global_zipf from the same corpus, in one pass over it.

    All letter tokens are counted per lemma at once, those that count as learnable
    apart.  The counts, a row a lemma, are written to the shared folder, so their
    total and whatever ranks them read those and not the corpus again.
    """
    require_columns(tokens, ["lemma", "sentence_id", "is_stop", "pos", "is_alpha"], "tokens")
    own = ~F.col("is_stop") & (F.col("pos") != "PROPN")
    rows = tokens.where("is_alpha").withColumn("__own", own)
    found = materialize(rows.groupBy("lemma").agg(*_counts(), F.count(F.lit(1)).alias("__n")), "lemma-counts")
    return _zipfed(found, "lemma", "book_freq", "doc_count", "verb_count", "other_pos_count", "stopword_count")


def _word_counts() -> list:
    """Sums over counted words; the sentences of a lemma cannot be told from them."""
    own = F.coalesce(F.sum(F.when(F.col("__own"), F.col("n"))), F.lit(0))
    verb = F.coalesce(F.sum(F.when((F.col("pos") == "VERB") & F.col("__own"), F.col("n"))), F.lit(0))
    stop = F.coalesce(F.sum(F.when(F.col("is_stop") & F.col("__own"), F.col("n"))), F.lit(0))
    return [own.alias("book_freq"), verb.alias("verb_count"), (own - verb).alias("other_pos_count"), stop.alias("stopword_count")]


def word_frequency(words: DataFrame, stop: bool = False, proper: bool = False, other: bool = False) -> DataFrame:
    """``lemma_frequency`` without doc_count, from counted words (``RegexAnnotator.counted``)."""
    require_columns(words, ["lemma", "is_stop", "pos", "is_alpha", "n"], "words")
    return learnable(words, stop, proper, other).withColumn("__own", F.lit(True)).groupBy("lemma").agg(*_word_counts())


def word_frequency_with_zipf(words: DataFrame) -> DataFrame:
    """``lemma_frequency_with_zipf`` without doc_count, from counted words."""
    require_columns(words, ["lemma", "is_stop", "pos", "is_alpha", "n"], "words")
    rows = words.where("is_alpha").withColumn("__own", ~F.col("is_stop") & (F.col("pos") != "PROPN"))
    found = materialize(rows.groupBy("lemma").agg(*_word_counts(), F.sum("n").alias("__n")), "lemma-counts")
    return _zipfed(found, "lemma", "book_freq", "verb_count", "other_pos_count", "stopword_count")


def _zipfed(found: DataFrame, *columns: str) -> DataFrame:
    total = found.agg(F.sum("__n").alias("__total"))
    zipf = F.log10(F.col("__n") / F.col("__total") * 1e9).alias("global_zipf")
    return found.where("book_freq > 0").crossJoin(F.broadcast(total)).select(*columns, zipf)


def corpus_zipf(tokens: DataFrame) -> DataFrame:
    """(lemma, zipf) of a corpus itself: log10 of occurrences in a thousand million."""
    counts = tokens.where("is_alpha").groupBy("lemma").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(
        "lemma", F.log10(F.col("n") / F.col("total") * 1e9).alias("zipf")
    )


def with_zipf(stats: DataFrame, words: DataFrame) -> DataFrame:
    """``stats`` with global_zipf from a table of word frequencies; unknown words are 0."""
    return stats.join(words, "lemma", "left").withColumn("global_zipf", F.coalesce("zipf", F.lit(0.0))).drop("zipf")


def by_frequency(stats: DataFrame, least: int | None = 3, low: float | None = 2.0, high: float | None = 5.5) -> DataFrame:
    """Rows within inclusive bounds; a bound of None is off, a zipf that is no number fails its bounds."""
    require_columns(stats, ["book_freq", "global_zipf"], "stats")
    zipf = F.col("global_zipf").try_cast("double")
    if least is not None:
        stats = stats.where(F.col("book_freq") >= least)
    if low is not None:
        stats = stats.where(zipf >= low)
    return stats.where(zipf <= high) if high is not None else stats


def ranked(candidates: DataFrame, target: float = 4.0) -> DataFrame:
    """``candidates`` with score: share of the largest frequency times rarity."""
    top = candidates.agg(F.max("book_freq").alias("__top"))
    share = F.when(F.col("__top") > 0, F.col("book_freq") / F.col("__top")).otherwise(F.lit(0.0))
    return (
        candidates.crossJoin(F.broadcast(top))
        .withColumn("score", share * rarity(F.col("global_zipf"), target))
        .drop("__top")
    )


def ranked_phrases(stats: DataFrame) -> DataFrame:
    """``stats`` with score: share of the largest frequency."""
    top = stats.agg(F.max("book_freq").alias("__top"))
    share = F.when(F.col("__top") > 0, F.col("book_freq") / F.col("__top")).otherwise(F.lit(0.0))
    return stats.crossJoin(F.broadcast(top)).withColumn("score", share).drop("__top")


def top(candidates: DataFrame, n: int, key: str = "lemma") -> DataFrame:
    """The ``n`` best by score, ties by key."""
    return candidates.orderBy(F.desc("score"), key).limit(n)


def without_dialect(df: DataFrame, column: str = "lemma", words: list[str] | None = None) -> DataFrame:
    """Rows whose lower-cased word is not on a list."""
    require_columns(df, [column], "df")
    return df.where(~F.lower(column).isin(*(words or lexicon.DIALECT)))
