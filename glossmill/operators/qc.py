"""Quality checks of cards, and gates over their rates."""

from __future__ import annotations

import difflib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill import lexicon
from glossmill.functions.scores import card_pos
from glossmill.functions.text import word_in_text
from glossmill.inflection import irregular_forms, word_forms
from glossmill.sources.shared import materialize

#: Least rates of a regression, and the most of serious findings.
SCHEMA_RATE, EXAMPLE_RATE, POS_RATE, SERIOUS_RATE = 1.0, 0.98, 0.98, 0.0


def lemma_missing(lemma: Column, examples: Column) -> Column:
    """Whether an example has no form of the lemma, regular or not; forms of words spelt alike do not count."""
    forms = F.array_union(word_forms(lemma), irregular_forms(lemma))
    for word, other in lexicon.HOMONYMS.items():
        forms = F.when(F.lower(lemma) == word, F.array_except(forms, F.array(*map(F.lit, other)))).otherwise(forms)
    return F.exists(examples, lambda x: ~F.exists(forms, lambda f: word_in_text(f, x)))


def pos_mismatch(cards: DataFrame, pos_lists: DataFrame) -> DataFrame:
    """Cards whose part of speech none of their examples has; unknown lemmas and parts of speech pass.

    ``cards`` has lemma, part_of_speech and indices (from 1); ``pos_lists`` has
    lemma and pos_list.
    """
    joined = cards.join(pos_lists, "lemma")
    name = card_pos(F.col("part_of_speech"))
    n = F.size("pos_list")
    chosen = F.transform(
        F.filter("indices", lambda i: (i >= 1) & (i <= n)), lambda i: F.upper(F.element_at("pos_list", i))
    )
    failing = (n > 0) & (name != "") & ~F.array_contains(chosen, name)
    return joined.where(failing).select(*cards.columns)


def plain_definition(text: str | None) -> str:
    """A definition as it is compared: lowered, trimmed, with single spaces."""
    return re.sub(r"\s+", " ", (text or "").strip().lower())


def _ratio(x: str, y: str) -> float:
    return difflib.SequenceMatcher(None, x, y).ratio() if x and y else float(x == y)


def similarity(a: str | None, b: str | None) -> float:
    """Likeness of two definitions, lowered and with single spaces, by matching blocks."""
    return _ratio(plain_definition(a), plain_definition(b))


def likeness(a: Column, b: Column) -> Column:
    """``similarity`` as an Arrow-batched column expression; matching blocks have no built-in."""
    return F.pandas_udf(lambda x, y: pd.Series(map(similarity, x, y), dtype="float64"), "double")(a, b)


#: Bins that the letters of a definition are counted in.
_BINS = 64


def _letters(texts: list[str]) -> np.ndarray:
    counts = np.zeros((len(texts), _BINS), np.int32)
    for row, text in enumerate(texts):
        np.add.at(counts[row], np.frombuffer(text.encode("utf-32-le"), np.uint32) % _BINS, 1)
    return counts


def like_pairs(earlier: pd.DataFrame, later: pd.DataFrame, threshold: float) -> Iterator[tuple[int, int]]:
    """(i, j) of the rows of two sets whose definitions are alike, by bounds first and matching blocks then.

    Twice the matched letters is at most the letters both have, counted by bin,
    so a pair whose counts differ in more than that leaves room for is never
    compared.  Lengths are the coarsest such bound.
    """
    a, b = (_letters(f["__plain"].tolist()) for f in (earlier, later))
    size_a, size_b = a.sum(axis=1), b.sum(axis=1)
    for j, text in enumerate(later["__plain"]):
        total = size_a + size_b[j]
        near = np.flatnonzero(2 * np.minimum(size_a, size_b[j]) >= threshold * total - 1e-9)
        shared = np.minimum(a[near], b[j]).sum(axis=1)
        for i in near[2 * shared >= threshold * total[near] - 1e-9]:
            if (earlier["__ord"].iat[i], earlier["__k"].iat[i]) < (later["__ord"].iat[j], later["__k"].iat[j]):
                if _ratio(text, earlier["__plain"].iat[i]) >= threshold:
                    yield int(i), j


def _like_edges(texts: DataFrame, threshold: float, block: int) -> DataFrame:
    """(lemma, a, b): pairs of different definitions of a lemma that are alike, a the earlier.

    Definitions fall into classes of length such that only those of one class or
    of two neighbouring ones can be alike, and a class into as many parts as it
    has ``block`` rows.  A task compares two parts, so a lemma is dealt over as
    many tasks as it has pairs of parts, and no task holds more than two of them.
    """
    ratio = threshold / (2 - threshold)
    # A hair wider than the bound, so that rounding of logarithms cannot part two that may be alike.
    width = -math.log(ratio) * (1 + 1e-9) if 0 < ratio < 1 else math.inf
    size = F.floor(F.log(F.length("__plain")) / F.lit(width)) if math.isfinite(width) else F.lit(0)
    classed = texts.where("__plain <> ''").withColumn("__class", size.cast("int") if ratio < 1 else F.length("__plain"))
    parts = classed.groupBy("lemma", "__class").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__parts"))
    near = parts.select("lemma", F.explode(F.array(*(F.struct((F.col("__class") + d).alias("__class"), F.lit(-d).alias("__step"), F.col("__parts").alias("__n")) for d in (-1, 0, 1))))).select("lemma", "col.*")
    reach = near.groupBy("lemma", "__class").agg(F.collect_list(F.struct("__step", "__n")).alias("__near"))
    own = classed.join(reach, ["lemma", "__class"]).withColumn(
        "__part", F.pmod(F.xxhash64("__plain"), F.element_at(F.filter("__near", lambda x: x["__step"] == 0), 1)["__n"]).cast("int")
    )
    others = F.flatten(F.transform("__near", lambda x: F.transform(F.sequence(F.lit(0), x["__n"] - 1), lambda p: F.struct((F.col("__class") + x["__step"]).alias("c"), p.alias("p")))))
    here = F.struct(F.col("__class").alias("c"), F.col("__part").alias("p"))
    met = own.withColumn("__here", here).withColumn("__other", F.explode(others))
    low, high = F.least("__here", "__other"), F.greatest("__here", "__other")
    met = met.select("lemma", "__ord", "__k", "__plain", low.alias("__low"), high.alias("__high"), "__here").select(
        "lemma", "__ord", "__k", "__plain", "__low", "__high", (F.col("__here") == F.col("__low")).alias("__first"), (F.col("__here") == F.col("__high")).alias("__second")
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame[frame["__first"]].reset_index(drop=True)
        second = frame[frame["__second"]].reset_index(drop=True)
        found = [(first, i, second, j) for i, j in like_pairs(first, second, threshold)]
        if not frame["__second"][frame["__first"]].any():
            found += [(second, i, first, j) for i, j in like_pairs(second, first, threshold)]
        rows = [(x["lemma"].iat[i], x["__ord"].iat[i], x["__k"].iat[i], y["__ord"].iat[j], y["__k"].iat[j]) for x, i, y, j in found]
        return pd.DataFrame(rows, columns=["lemma", "__ord", "__k", "__ord_b", "__k_b"])

    kind = texts.schema["__ord"].dataType.simpleString()
    schema = f"lemma {texts.schema['lemma'].dataType.simpleString()}, __ord {kind}, __k int, __ord_b {kind}, __k_b int"
    edges = met.groupBy("lemma", "__low", "__high").applyInPandas(lambda f: compare(f.drop(columns=["__low", "__high"])), schema)
    return edges.select("lemma", F.struct("__ord", "__k").alias("a"), F.struct(F.col("__ord_b").alias("__ord"), F.col("__k_b").alias("__k")).alias("b")).distinct()


def _greedy(edges: DataFrame) -> DataFrame:
    """(lemma, v) of the vertices that a keep-first choice drops, from edges (lemma, a, b) with a before b.

    In each round the vertices with no earlier neighbour left are kept, their
    later neighbours go, and so do all edges of both; what is left is the same
    problem, smaller.  Every round is written, so a lost executor costs a round.
    """
    edges = materialize(edges, "like")
    gone = edges.select("lemma", F.col("b").alias("v")).limit(0)
    while not edges.isEmpty():
        kept = edges.select("lemma", F.col("a").alias("v")).join(edges.select("lemma", F.col("b").alias("v")), ["lemma", "v"], "left_anti").distinct()
        hit = materialize(edges.join(kept.withColumnRenamed("v", "a"), ["lemma", "a"]).select("lemma", F.col("b").alias("v")).distinct(), "gone")
        settled = kept.unionByName(hit)
        left = edges.join(settled.withColumnRenamed("v", "a"), ["lemma", "a"], "left_anti").join(hit.withColumnRenamed("v", "b"), ["lemma", "b"], "left_anti")
        edges = materialize(left.select("lemma", "a", "b"), "like")
        gone = gone.unionByName(hit)
    return gone


def duplicate_senses(cards: DataFrame, threshold: float = 0.85, block: int = 1000) -> DataFrame:
    """``cards`` (lemma, ord, definition_en, ..) that repeat an earlier kept card of their lemma.

    The choice is greedy and in order: a card goes if its definition is alike, by
    matching blocks, to that of a kept card before it.  Equal definitions are one
    at first: all but the first always go.  Different ones are compared in blocks
    over many tasks, and the choice is made on the pairs found, so no task holds
    a lemma.  Of cards with one ord, the order is that of their definitions, then
    of all their columns.  Cards without a lemma are left out; a null definition
    counts as empty.
    """
    plain = F.pandas_udf(lambda s: s.map(plain_definition), "string")
    placed = Window.partitionBy("lemma", "ord").orderBy("definition_en", F.xxhash64(*cards.columns))
    known = F.when(F.col("ord").isNotNull(), F.col("ord")).otherwise(F.raise_error(F.lit("a card has no ord")).cast(cards.schema["ord"].dataType))
    rows = cards.where("lemma is not null and lemma <> ''").withColumn("__k", F.row_number().over(placed)).withColumn("__ord", known)
    rows = materialize(rows.withColumn("__plain", plain(F.coalesce("definition_en", F.lit("")))), "cards")
    texts = rows.groupBy("lemma", "__plain").agg(F.min(F.struct("__ord", "__k")).alias("v"))
    texts = materialize(texts.select("lemma", "__plain", "v.*"), "definitions")
    gone = _greedy(_like_edges(texts, threshold, block)).select("lemma", "v.*")
    keys = ["lemma", "__ord", "__k"]
    kept = texts.select(keys).join(gone, keys, "left_anti")
    return rows.join(kept, keys, "left_anti").select(cards.columns)


def valid_schema(fields: dict[str, Column], examples: Column, indices: Column) -> Column:
    """Whether a card's text fields are filled, it has examples, and its indices are a list of whole numbers in JSON."""
    filled = [F.coalesce(F.trim(value), F.lit("")) != "" for value in fields.values()]
    whole = F.coalesce(indices, F.lit("")).rlike("^\\s*\\[\\s*(-?[0-9]+\\s*(,\\s*-?[0-9]+\\s*)*)?\\]\\s*$")
    return reduce(lambda a, b: a & b, filled) & (F.coalesce(F.size(examples), F.lit(-1)) > 0) & whole


def lemma_in_text(lemma: Column, text: Column) -> Column:
    """Whether a text has a form of a lemma as a word, or the lemma as a part of any word."""
    forms = F.array_union(word_forms(lemma), irregular_forms(lemma))
    either = F.contains(F.lower(text), F.lower(lemma)) | F.exists(forms, lambda f: word_in_text(f, text))
    return F.coalesce(either, F.lit(False))


def share_check(rows: DataFrame, failed: Column, most: float) -> DataFrame:
    """One row (total, failures, rate, passed): the share of rows that fail, and whether it is within its threshold; no rows pass."""
    counts = rows.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.count_if(failed), F.lit(0)).alias("failures"))
    rate = F.when(F.col("total") > 0, F.col("failures") / F.col("total")).otherwise(F.lit(0.0))
    return counts.withColumn("rate", rate).withColumn("passed", F.col("rate") <= most)


def findings(rows: DataFrame, key: str, column: str, parts: tuple[str, ...] = (), words: tuple[str, ...] = (), equal: tuple[str, ...] = ()) -> DataFrame:
    """(key, test, value): a row for every value that a text holds as a part, as a whole word, or is equal to, cases apart for parts."""
    text = F.col(column)
    tests = [F.when(F.contains(text, F.lit(v)), F.struct(F.lit("part").alias("test"), F.lit(v).alias("value"))) for v in parts]
    tests += [F.when(word_in_text(F.lit(v), text), F.struct(F.lit("word").alias("test"), F.lit(v).alias("value"))) for v in words]
    tests += [F.when(text == v, F.struct(F.lit("equal").alias("test"), F.lit(v).alias("value"))) for v in equal]
    return rows.select(key, F.inline(F.array_compact(F.array(*tests))))


def error_rates(errors: DataFrame, cards: int, thresholds: dict[str, float], other: float = 0.0) -> DataFrame:
    """(error_type, n, rate, threshold, failed) of a table of errors beside a number of cards."""
    total = errors.agg((F.count(F.lit(1)) + F.lit(cards)).alias("__total"))
    most = F.lit(float(other))
    for name, value in thresholds.items():
        most = F.when(F.col("error_type") == name, F.lit(float(value))).otherwise(most)
    counts = errors.groupBy(F.coalesce("error_type", F.lit("other")).alias("error_type")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(total)).select(
        "error_type",
        "n",
        (F.col("n") / F.col("__total")).alias("rate"),
        most.alias("threshold"),
        (F.col("n") / F.col("__total") > most).alias("failed"),
    )


def regression(checked: DataFrame) -> DataFrame:
    """One row of rates and whether they pass, from cards with schema_ok, example_ok, pos_ok and serious."""
    rates = checked.agg(
        F.count(F.lit(1)).alias("total_cards"),
        *[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(1.0)).alias(f"{c}_rate") for c in ("schema_ok", "example_ok", "pos_ok")],
        F.coalesce(F.avg(F.col("serious").cast("double")), F.lit(0.0)).alias("serious_rate"),
    )
    return rates.withColumn(
        "passed",
        (F.col("schema_ok_rate") >= SCHEMA_RATE)
        & (F.col("example_ok_rate") >= EXAMPLE_RATE)
        & (F.col("pos_ok_rate") >= POS_RATE)
        & (F.col("serious_rate") <= SERIOUS_RATE),
    )
