"""Whole runs: where their files lie, and the steps from documents to a deck or a sample.

``python -m glossmill vocabulary --documents DIR --book NAME --out DIR`` runs the first,
``python -m glossmill sample`` the second.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.operators import examples, gold, qc, stats, tokens


@dataclass(frozen=True)
class Paths:
    """Where the files of books lie below a folder."""

    root: str

    def _processed(self, book: str, name: str) -> str:
        return f"{self.root}/processed/{book}_{name}.parquet"

    def raw(self, book: str) -> str:
        return f"{self.root}/raw/{book}.epub"

    def tokens(self, book: str) -> str:
        return self._processed(book, "tokens")

    def sentences(self, book: str) -> str:
        return self._processed(book, "sentences")

    def lemma_stats(self, book: str) -> str:
        return self._processed(book, "lemma_stats")

    def phrases(self, book: str) -> str:
        return self._processed(book, "phrasal_verbs")

    def deck(self, book: str) -> str:
        return f"{self.root}/anki_exports/{book}_anki.csv"

    def requests(self, book: str) -> str:
        return f"{self.root}/batch/{book}/requests.jsonl"

    def results(self, book: str) -> str:
        return f"{self.root}/batch/{book}/results.jsonl"

    def sample_stats(self, book: str) -> str:
        return f"{self.root}/experiment/{book}_sample_stats.json"


def candidates_path(sentences: str) -> str:
    """The path of the phrase candidates that belong to a sentences table."""
    folder, name = posixpath.split(sentences)
    stem = posixpath.splitext(name)[0]
    base = stem.removesuffix("_sentences")
    return posixpath.join(folder, f"{base}_mwe_candidates.parquet" if base != stem else "mwe_candidates.parquet")


def vocabulary(docs: DataFrame, book: str, paths: Paths, top_n: int = 100, with_examples: bool = True) -> None:
    """Write a book's sentences, tokens, ranked statistics and deck."""
    spark = docs.sparkSession
    tokens.sentences(docs).write.mode("overwrite").parquet(paths.sentences(book))
    sentences = spark.read.parquet(paths.sentences(book))
    tokens.RegexAnnotator().tokens(sentences).write.mode("overwrite").parquet(paths.tokens(book))
    found = spark.read.parquet(paths.tokens(book))
    ranked = stats.ranked(stats.by_frequency(stats.lemma_frequency_with_zipf(found)))
    ranked.write.mode("overwrite").parquet(paths.lemma_stats(book))
    best = stats.top(spark.read.parquet(paths.lemma_stats(book)), top_n)
    shown = examples.for_candidates(best, found, sentences) if with_examples else best.withColumn("example", F.lit(None).cast("string"))
    examples.anki(shown, "lemma", book).write.mode("overwrite").csv(paths.deck(book), header=True)


def sample(docs: DataFrame, book: str, paths: Paths, size: int, seed: int = 42) -> DataFrame:
    """Write a seeded sample of sentences with its tokens and statistics; returns the statistics, one row.

    Ids that repeat, or tokens without a sentence, are an error.
    """
    spark = docs.sparkSession
    chosen = gold.sample(tokens.sentences(docs), "sentence_id", size, seed)
    chosen.write.mode("overwrite").parquet(paths.sentences(book))
    sentences = spark.read.parquet(paths.sentences(book))
    tokens.RegexAnnotator().tokens(sentences).write.mode("overwrite").parquet(paths.tokens(book))
    found = spark.read.parquet(paths.tokens(book))
    problems = tokens.check_sentences(found, sentences).limit(1).collect()
    if problems:
        raise ValueError(f"the sample has a {problems[0]['problem']} sentence id {problems[0]['sentence_id']}")
    own = tokens.content(found)
    counts = (
        sentences.agg(F.count(F.lit(1)).alias("sentences"))
        .crossJoin(found.agg(F.count(F.lit(1)).alias("tokens")))
        .crossJoin(own.agg(F.count(F.lit(1)).alias("content_tokens"), F.count_distinct("lemma").alias("content_lemmas")))
    )
    counts.write.mode("overwrite").json(paths.sample_stats(book))
    return spark.read.schema("sentences long, tokens long, content_tokens long, content_lemmas long").json(paths.sample_stats(book))


def evaluate_stored(spark: SparkSession, path: str) -> tuple[bool, str, int]:
    """(passed, message, cards) of the regression checks over stored cards; a missing file fails and raises nothing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return False, f"no cards at {path}", 0
    row = qc.regression(spark.read.parquet(path)).first()
    least = {"schema_ok_rate": qc.SCHEMA_RATE, "example_ok_rate": qc.EXAMPLE_RATE, "pos_ok_rate": qc.POS_RATE}
    failing = [n for n, v in least.items() if row[n] < v] + (["serious_rate"] if row["serious_rate"] > qc.SERIOUS_RATE else [])
    return row["passed"], ",".join(failing), row["total_cards"]
