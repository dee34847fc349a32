"""Word families: example groups, requests, results and their cards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions.scores import pos_shares
from glossmill.functions.text import strip_fences, target_in_text
from glossmill.lexicon import CONTENT_POS
from glossmill.operators.tokens import RegexAnnotator, content
from glossmill.schemas import CARD, require_columns
from glossmill.sources.shared import materialize

REQUIRED = ("definition_en", "definition_ru", "part_of_speech")


def uses(tokens: DataFrame, sentences: DataFrame | None = None, by: tuple[str, ...] = ("lemma", "sentence_id")) -> DataFrame:
    """(lemma, sentence_id, pos): every sentence of every lemma, with the part of speech of the first use in it.

    With ``sentences``, uses in other sentences are left out; tokens made from the
    sentences at hand need no such join.  Place and part of speech of a token are
    one number, so that the first is found by hashing.  ``by`` deals the tokens out:
    by lemma alone, all uses of a lemma lie in one place, ready for a window.
    """
    code = (F.array_position(F.array(*map(F.lit, CONTENT_POS)), F.col("pos")) - 1).cast("long")
    rows = content(tokens).select("lemma", "sentence_id", (F.col("position").cast("long") * len(CONTENT_POS) + code).alias("__first"))
    rows = rows.repartition(*by) if by != ("lemma", "sentence_id") else rows
    first = rows.groupBy("lemma", "sentence_id").agg(F.min("__first").alias("__first"))
    pos = F.element_at(F.array(*map(F.lit, CONTENT_POS)), F.pmod("__first", F.lit(len(CONTENT_POS))).cast("int") + 1)
    own = first.select("lemma", "sentence_id", pos.alias("pos"))
    return own if sentences is None else own.join(sentences.where("sentence <> ''").select("sentence_id"), "sentence_id", "left_semi")


def made_uses(sentences: DataFrame, *more: str) -> DataFrame:
    """(lemma, sentence_id, __first, ..) of the built-in tokens: place and part of speech of a use as one number, with columns ``more`` of its sentence.

    A word that its sentence had before is left out where it is split; different words of one lemma are not.
    """
    code = (F.array_position(F.array(*map(F.lit, CONTENT_POS)), F.col("pos")) - 1).cast("long")
    found = content(RegexAnnotator().rows(sentences, *more, once=True))
    return found.select("lemma", "sentence_id", (F.col("position").cast("long") * len(CONTENT_POS) + code).alias("__first"), *more)


def placed_uses(uses: DataFrame, size: int, *ties: str) -> DataFrame:
    """``made_uses`` with pos and block, ``size`` sentences of a lemma in each; of several in a sentence the first is left, equal ones by ``ties``.

    Uses are dealt out by lemma and sorted once; the first of each sentence is found in that order, not by hashing.
    """
    again = F.row_number().over(Window.partitionBy("lemma", "sentence_id").orderBy("__first", *ties))
    place = F.row_number().over(Window.partitionBy("lemma").orderBy("sentence_id")) - 1
    pos = F.element_at(F.array(*map(F.lit, CONTENT_POS)), F.pmod("__first", F.lit(len(CONTENT_POS))).cast("int") + 1)
    first = uses.repartition("lemma").withColumn("__again", again).where("__again = 1")
    return first.withColumns({"block": F.floor(place / F.lit(size)).cast("int"), "pos": pos}).drop("__again", "__first")


def _counted(over: Callable[[Column], Column]) -> list[Column]:
    seen = [F.when(over(F.count_if(F.col("pos") == p)) > 0, p) for p in sorted(CONTENT_POS)]
    return [over(F.count(F.lit(1))).alias("example_count"), F.array_compact(F.array(*seen)).alias("pos_variants")]


def counts(uses: DataFrame) -> DataFrame:
    """(lemma, example_count, pos_variants) of ``uses``: sentences and parts of speech of each lemma."""
    return uses.groupBy("lemma").agg(*_counted(lambda c: c))


def groups(tokens: DataFrame, sentences: DataFrame, most: int = 100, made: bool = False) -> DataFrame:
    """Per lemma its first ``most`` sentences, counts of all, and the parts of speech of all.

    Lemmas are counted and cut on ids alone; texts join only the sentences that
    are left.  ``example_blocks`` gives all sentences, in lists of bounded length.
    ``made`` tells that the tokens were made from these sentences.
    """
    # Tokens are read and dealt out by lemma once: uses are counted, and cut, in one window.
    own = uses(tokens, by=("lemma",)) if made else uses(tokens.where("lemma is not null"), sentences)
    every = Window.partitionBy("lemma")
    placed = own.select("*", F.row_number().over(every.orderBy("sentence_id")).alias("__n"), *_counted(lambda c: c.over(every)))
    kept = placed.where(F.col("__n") <= most).drop("__n")
    texts = kept.join(sentences.select("sentence_id", F.col("sentence").alias("text")), "sentence_id")
    return texts.groupBy("lemma").agg(
        F.array_sort(F.collect_list(F.struct("sentence_id", "text", "pos"))).alias("examples"),
        F.first("pos_variants").alias("pos_variants"),
        F.first("example_count").alias("example_count"),
    )


def example_blocks(tokens: DataFrame, sentences: DataFrame, size: int = 100, made: bool = False) -> DataFrame:
    """(lemma, block, offset, examples): all sentences of each lemma in order, ``size`` to a block, numbered from 0.

    ``made`` tells that the tokens were made from these sentences.
    """
    place = F.row_number().over(Window.partitionBy("lemma").orderBy("sentence_id")) - 1
    own = uses(tokens, by=("lemma",)) if made else uses(tokens, sentences)
    placed = own.withColumn("block", F.floor(place / F.lit(size)).cast("int"))
    texts = placed.join(sentences.select("sentence_id", F.col("sentence").alias("text")), "sentence_id")
    listed = texts.groupBy("lemma", "block").agg(F.array_sort(F.collect_list(F.struct("sentence_id", "text", "pos"))).alias("examples"))
    return listed.select("lemma", "block", (F.col("block") * size).alias("offset"), "examples")


#: Bytes of examples in a part of all lemmas, and the most parts.
PART_BYTES, MOST_PARTS = 1 << 27, 48
#: Files of uses with their texts: a text is stored once for all of its lemmas as long as the dictionary of a row group holds it.
_ONCE = {"compression": "zstd", "parquet.block.size": str(8 << 20), "parquet.dictionary.page.size": str(16 << 20)}


def block_parts(sentences: DataFrame, size: int = 100) -> list[DataFrame]:
    """All of ``example_blocks`` of the built-in tokens, dealt by lemma into parts to be read one after another.

    A sentence stands in the examples of each of its lemmas, so all examples are many times
    the texts.  Uses are written once, in order of the texts, and a part takes those of its
    lemmas from there: only its own examples are dealt out at a time.
    """
    own = materialize(made_uses(sentences, "sentence").withColumnRenamed("sentence", "text"), "uses", **_ONCE)
    room = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, min(MOST_PARTS, -(-room // PART_BYTES)))
    return [_blocks_of(own.where(F.pmod(F.xxhash64("lemma"), F.lit(n)) == k), size) for k in range(n)]


def _blocks_of(uses: DataFrame, size: int) -> DataFrame:
    """``example_blocks`` of uses with their texts (lemma, sentence_id, __first, text); of several in a sentence, the first counts."""
    rows = F.collect_list(F.struct("sentence_id", "text", "pos"))
    listed = placed_uses(uses, size, "text").groupBy("lemma", "block").agg(F.sort_array(rows).alias("examples"))
    return listed.select("lemma", "block", (F.col("block") * size).alias("offset"), "examples")


def merge_blocks(cards: DataFrame) -> DataFrame:
    """Cards of blocks (lemma, offset, indices from 1, ..) with indices into all examples of the lemma."""
    moved = F.transform("indices", lambda i: i + F.col("offset"))
    return cards.withColumn("indices", moved).drop("offset")


def prompt(lemma: Column, examples: Column, shares: Column | None = None) -> Column:
    """The text of a request: the lemma, numbered examples and, if given, their parts of speech."""
    numbered = F.array_join(F.transform(examples, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    text = F.concat(F.lit("Group the meanings of '"), lemma, F.lit("' in these examples:\n"), numbered)
    if shares is None:
        return text
    hint = F.concat(F.lit("\n\nPOS distribution in the examples above: "), shares, F.lit("."))
    return F.concat(text, F.when(shares != "", hint).otherwise(F.lit("")))


def requests(groups: DataFrame, model: str, most: int, limit: int | None = None) -> DataFrame:
    """(key, request): one JSON request for each lemma, by lemma, the first ``limit`` of them."""
    cut = F.slice("examples", 1, most)
    n = F.size("pos_variants").cast("long")
    shares = pos_shares(F.transform("pos_variants", lambda p: F.struct(p.alias("pos"), F.lit(1).cast("long").alias("n"))))
    text = prompt(F.col("lemma"), F.transform(cut, lambda x: x["text"]), F.when(n > 0, shares).otherwise(F.lit("")))
    request = F.struct(
        F.lit(model).alias("model"),
        F.array(F.struct(F.array(F.struct(text.alias("text"))).alias("parts"))).alias("contents"),
        F.struct(
            F.lit(0.0).alias("temperature"),
            F.lit(16384).alias("maxOutputTokens"),
            F.lit("application/json").alias("responseMimeType"),
        ).alias("generationConfig"),
    )
    rows = groups.select(F.concat(F.lit("lemma:"), F.col("lemma")).alias("key"), F.to_json(request).alias("request"), "lemma")
    ordered = rows.orderBy("lemma")
    return (ordered.limit(limit) if limit else ordered).drop("lemma")


def parse(results: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, lemma, error, ord, card) of results (key, response JSON text); one row with an error, or one a card.

    Columns ``keep`` of results come along; a lemma among them stands for that of the key.

    Errors: bad_key, no_candidates, empty_content, json_error.
    """
    require_columns(results, ["key", "response"], "results")
    shape = "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>"
    first = F.from_json("response", shape)["candidates"]
    text = F.trim(F.try_element_at(F.try_element_at(first, F.lit(1))["content"]["parts"], F.lit(1))["text"])
    body = strip_fences(F.col("__text"))
    cards = F.from_json(body, f"cards array<struct<{CARD.replace(' ', ':').replace(',:', ',')}>>")
    lemma = F.when(F.col("key").startswith("headword:"), F.trim(F.substring("key", 10, 1 << 20))).when(
        F.col("key").startswith("lemma:"), F.substring("key", 7, 1 << 20)
    )
    valid = F.try_parse_json(body).isNotNull()
    more = [c for c in keep if c != "lemma"]
    # The key is judged all the same, and its lemma gives way afterwards.
    given = [F.col("lemma").alias("__lemma")] if "lemma" in keep else []
    rows = results.select("key", lemma.alias("lemma"), *more, *given, first.alias("__first"), text.alias("__text"))
    error = (
        F.when(F.col("lemma").isNull(), "bad_key")
        .when(F.coalesce(F.size("__first"), F.lit(0)) <= 0, "no_candidates")
        .when(F.coalesce(F.col("__text"), F.lit("")) == "", "empty_content")
        .when(~valid, "json_error")
    )
    made = rows.withColumn("error", error).withColumn("__cards", F.when(error.isNull(), cards["cards"]))
    named = F.col("__lemma") if given else F.coalesce("lemma", F.lit(""))
    return made.select("key", named.alias("lemma"), *more, "error", F.posexplode_outer("__cards").alias("ord", "card"))


def indices(raw: Column) -> Column:
    """Whole numbers of a JSON list in text form; true is 1, false 0, all else is left out."""
    parts = F.transform(F.split(F.regexp_replace(raw, "[\\[\\]\\s]", ""), ","), lambda p: F.trim(p))
    kept = F.filter(parts, lambda p: p.rlike("^-?[0-9]+$") | p.isin("true", "false"))
    return F.transform(kept, lambda p: F.when(p == "true", 1).when(p == "false", 0).otherwise(p.try_cast("int")))


def with_examples(cards: DataFrame, examples: DataFrame) -> DataFrame:
    """Parsed cards with the examples their indices choose.

    ``examples`` has lemma and examples (array of texts).  Indices count from 0 if
    0 is among them and all are below the number of examples, else from 1.
    """
    joined = cards.join(examples.select("lemma", F.col("examples").alias("__all")), "lemma", "left")
    none = F.expr("cast(array() as array<string>)")
    every = F.coalesce("__all", none)
    raw = F.coalesce(indices(F.col("card.selected_example_indices")), F.expr("cast(array() as array<int>)"))
    n = F.size(every)
    zero = F.array_contains(raw, 0) & (F.array_max(raw) < n)
    base = F.when(zero, 1).otherwise(0)
    picked = F.transform(F.filter(raw, lambda i: (i + base > 0) & (i + base <= n)), lambda i: F.element_at(every, i + base))
    rows = joined.withColumn("examples", picked)
    return rows.select(
        "key",
        "lemma",
        "ord",
        "card.*",
        "examples",
        ((F.size("examples") == 0) & (F.size(every) > 0)).alias("examples_fallback"),
    )


def problems(card_fields: dict[str, Column]) -> Column:
    """Messages on empty required fields of a card."""
    tests = [
        F.when(F.coalesce(F.trim(card_fields[k]), F.lit("")) == "", F.lit(f"missing or empty '{k}'")) for k in REQUIRED
    ]
    tests.append(F.when(card_fields["selected_example_indices"].isNull(), F.lit("missing selected_example_indices")))
    return F.array_compact(F.array(*tests))


def valid(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cards without problems, and (lemma, stage, error_type, message) of the others."""
    fields = {k: F.col(k) for k in (*REQUIRED, "selected_example_indices")}
    checked = cards.withColumn("__problems", problems(fields))
    bad = checked.where(F.size("__problems") > 0).select(
        "lemma",
        F.lit("download").alias("stage"),
        F.lit("validation").alias("error_type"),
        F.array_join("__problems", "; ").alias("message"),
    )
    return checked.where(F.size("__problems") == 0).drop("__problems"), bad


def headword_holds(headword: Column, examples: Column) -> Column:
    """Whether a headword stands in every one of at least one example."""
    return (F.size(examples) > 0) & F.forall(examples, lambda x: target_in_text(headword, x))


def retry_lemmas(parsed: DataFrame, empty: bool = True, fallback: bool = True) -> DataFrame:
    """Lemmas of cards without examples or with the fallback mark."""
    test = F.lit(False)
    if empty:
        test = test | (F.size("examples") == 0)
    if fallback:
        test = test | F.col("examples_fallback")
    return parsed.where(test).select("lemma").distinct()


def merge_retries(cards: DataFrame, retried: DataFrame) -> DataFrame:
    """``cards`` with all cards of retried lemmas replaced."""
    kept = cards.join(retried.select("lemma").distinct(), "lemma", "left_anti")
    return kept.select(*cards.columns).unionByName(retried)
