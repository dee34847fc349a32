"""Records of labelled sets in JSON lines, and vectors of texts, each with a store of their own."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill import lexicon
from glossmill.operators.gold import CONFIDENT
from glossmill.sources.shared import exists

LABEL = "synset_id string, confidence double, flags array<string>, raw_text string, cached_tokens int, judge_count int"


def label_outputs(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """Labels in JSON lines; a line without flags, text, tokens or judges has none, "", 0 and 2."""
    rows = spark.read.schema(f"{keys}, {LABEL}").json(path)
    return rows.withColumns(
        {
            "flags": F.coalesce("flags", F.expr("cast(array() as array<string>)")),
            "raw_text": F.coalesce("raw_text", F.lit("")),
            "cached_tokens": F.coalesce("cached_tokens", F.lit(0)),
            "judge_count": F.coalesce("judge_count", F.lit(2)),
        }
    )


def needs_referee() -> Column:
    """Whether one judge's output needs another: unsure, or a flag that asks for it."""
    flagged = F.exists("flags", lambda f: f.isin(*lexicon.REFEREE_FLAGS))
    return (F.coalesce("confidence", F.lit(0.0)) < CONFIDENT) | flagged


#: Numbers of a subword vector: one for each digit of a gram's hash.
DIMENSIONS = 32


def subwords(text: Column) -> Column:
    """A unit vector of a text from the three-letter pieces of its words, by a random projection.

    Each piece, with marks at a word's ends, is hashed, and each digit of the hash
    adds to one number of the vector: the digits are the random directions, the
    same on every machine, and nothing is trained or stored.  Texts that share
    pieces come out near, and a text without words is all zeros.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))

    def pieces(word: Column) -> Column:
        marked = F.concat(F.lit("<"), word, F.lit(">"))
        return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.md5(F.substr(marked, i, F.lit(3))))

    hashes = F.flatten(F.transform(words, pieces))

    def number(hashed: Column, place: Column) -> Column:
        return F.instr(F.lit("0123456789abcdef"), F.substr(hashed, place, F.lit(1))) * 2 - 17

    def summed(all_hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(1), F.lit(DIMENSIONS)), lambda d: F.aggregate(all_hashes, F.lit(0), lambda a, h: a + number(h, d)).cast("double")
        )

    def unit(vector: Column) -> Column:
        size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x * x))
        return F.when(size > 0, F.transform(vector, lambda x: x / size)).otherwise(vector)

    # Bound in lambdas, so that pieces are hashed once and summed once.
    return F.element_at(F.transform(F.transform(F.array(hashes), summed), unit), 1)


def by_model(load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Callable[[Column], Column]:
    """``embed`` for ``embedded`` by a model that each worker loads once and calls with batches of texts.

    ``load`` is a function of a module; it returns one from texts to vectors.
    """

    def embed(text: Column) -> Column:
        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            name = f"{load.__module__}.{load.__qualname__}"
            if name not in _LOADED:
                _LOADED[name] = load()
            return pd.Series(list(_LOADED[name](texts.fillna("").tolist())))

        return run(text)

    return embed


#: Models of this worker.
_LOADED: dict = {}


def embedded(texts: DataFrame, path: str, embed: Callable[[Column], Column]) -> DataFrame:
    """(key, vector, source): vectors of ``texts`` (key, text), made only where the store at ``path`` has none and then kept there."""
    spark = texts.sparkSession
    there = exists(spark, path)
    named = texts.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    kind = "digest string, vector array<double>, round int"
    have = spark.read.schema(kind).parquet(path) if there else spark.createDataFrame([], kind)
    round_ = (have.agg(F.max("round")).first()[0] or 0) + 1
    new = named.join(have, "digest", "left_anti").dropDuplicates(["digest"])
    new.select("digest", embed(F.col("text")).alias("vector"), F.lit(round_).alias("round")).write.mode("append").parquet(path)
    every = spark.read.schema(kind).parquet(path)
    source = F.when(F.col("round") < round_, "cache").otherwise("model")
    return named.join(every, "digest").select("key", "vector", source.alias("source"))
