"""From texts to sentences and tokens, and back."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill import inflection, lexicon
from glossmill.functions.text import LETTERS
from glossmill.schemas import require_columns
from glossmill.sources.shared import materialize

#: Sentences a book may have; ids are book number times this plus the place.
SENTENCES_PER_BOOK = 10_000_000
SENTENCE = "[^.!?\\n]+[.!?]*"
#: ``LETTERS`` with those below U+0100 one by one, and the digits: the pattern engine looks these up in a table, and tries ranges one after another.
_LETTERS = "".join(c for c in map(chr, range(256)) if re.match(f"[{LETTERS}]", c)) + "Ā-ɏ"
_DIGITS = "0123456789"
TOKEN = f"[{_LETTERS}]+(?:'[a-z]+)?|[{_DIGITS}]+|[^ \\t\\n\\r\\f\\x0B{_DIGITS}{_LETTERS}]"
DETERMINERS = ("the", "a", "an")
JOINERS = ("and", "or", "but")


class Annotator(Protocol):
    """Turns sentences into tokens; a model of a language can stand in for the built-in rules."""

    def tokens(self, sentences: DataFrame) -> DataFrame:
        """(book, sentence_id, sentence) to the columns of ``schemas.TOKENS``."""


def sentences(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(book, sentence_id, sentence): non-empty trimmed sentences, numbered within a book from 0.

    A row is a book, and ids are unique if ``doc_id`` is.  A book of more sentences
    than its numbers, or a number that ids cannot hold, is an error when it is read.
    """
    found = F.filter(
        F.transform(F.regexp_extract_all(F.col(text), F.lit(SENTENCE), F.lit(0)), lambda s: F.trim(s, F.lit(" \t\r"))),
        lambda s: s != "",
    )
    rows = docs.select(F.col(doc_id), F.posexplode(found).alias("at", "sentence"))
    at = F.when(F.col("at") < SENTENCES_PER_BOOK, F.col("at")).otherwise(F.raise_error(F.lit("a book has too many sentences")).cast("int"))
    return rows.select(
        F.col(doc_id).cast("string").alias("book"),
        (F.col(doc_id).cast("long") * SENTENCES_PER_BOOK + at).alias("sentence_id"),
        "sentence",
    )


def _is_letter(first: Column) -> Column:
    """Whether a first character is a letter; the pattern is for the few that are none of the plain ones."""
    return first.between("a", "z") | first.between("A", "Z") | first.rlike(f"[{LETTERS}]")


def tag(surface: Column, lower: Column, position: Column, irregular: Column) -> Column:
    """A part of speech by closed classes, irregular forms and endings; a fallback, not a parser.

    ``lower`` is the lower-cased surface, ``irregular`` the part of speech of an
    irregular form, else null.  A token is letters, digits or one other
    character, so its first character tells which.
    """
    first = F.substring(surface, 1, 1)

    def ends(*endings: str) -> Column:
        return reduce(lambda a, b: a | b, (F.endswith(lower, F.lit(e)) for e in endings))

    return (
        F.when(first.between("0", "9"), "NUM")
        .when(~_is_letter(first), "PUNCT")
        .when(lower.isin(*DETERMINERS), "DET")
        .when(lower.isin(*JOINERS), "CCONJ")
        .when(lower.isin(*lexicon.IGNORED_FUNCTION_WORDS, *lexicon.KEPT_FUNCTION_WORDS), "ADP")
        .when((position > 0) & first.between("A", "Z"), "PROPN")
        .when(irregular.isNotNull(), irregular)
        .when(ends("ly"), "ADV")
        .when(ends("ing", "ed"), "VERB")
        .when(ends("ble", "ous", "ful", "ive", "al"), "ADJ")
        .otherwise("NOUN")
    )


def lemma_of(lower: Column, pos: Column, is_stop: Column, irregular: Column) -> Column:
    """The lemma of a tagged word: names as they are, then irregular forms, closed classes as they are, then endings."""
    closed = is_stop | ~pos.isin(*lexicon.CONTENT_POS)
    return F.when(pos == "PROPN", lower).otherwise(F.coalesce(irregular, F.when(closed, lower).otherwise(inflection.regular_lemma(lower))))


def _listed(sentences: DataFrame, surfaces: Column) -> DataFrame:
    """Sentences with their list of words; the generator leaves out the empty ones without looking for words a second time."""
    some = F.filter(F.array(surfaces), lambda words: F.size(words) > 0)
    return sentences.select("book", "sentence_id", F.explode(some).alias("surfaces"))


class RegexAnnotator:
    """Tokens by one pattern, lemmas by rules of endings and a dimension of irregular forms.

    ``irregulars`` (form, lemma, pos) stands in for the built-in dimension; a
    form must be there once.  The built-in one has some hundred rows, so the
    optimizer sends it to all tasks and tokens are not shuffled.
    """

    def __init__(self, irregulars: DataFrame | None = None):
        self.irregulars = irregulars

    def tokens(self, sentences: DataFrame) -> DataFrame:
        return self.rows(sentences).select(
            "book", "sentence_id", "position", "surface", "lemma", "pos", "is_stop", "is_alpha", F.lit(" ").alias("whitespace")
        )

    def rows(self, sentences: DataFrame, *more: str, ahead: int = 0, only: DataFrame | None = None, once: bool = False) -> DataFrame:
        """Tokens with the columns ``more`` of their sentence and, in ``words``, as many of the next words as ``ahead`` says.

        No token carries its whole sentence, so a sentence of very many words stays
        linear.  ``only`` (form, ..) keeps tokens of these lower-cased forms, with its
        columns; the others are left out before anything is tagged.  It is a dictionary and
        goes to all tasks: rows made from small numbers look smaller than it, and the
        optimizer would send the tokens instead.  ``once`` leaves out words that their
        sentence had before, and places count what is left: the first place stays the first.
        """
        words = F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0))
        words = F.array_distinct(words) if once else words
        if ahead:
            split = sentences.select("book", "sentence_id", *more, words.alias("__words"))
            each = F.transform("__words", lambda w, i: F.struct(w.alias("surface"), F.slice("__words", i + 2, ahead).alias("words")))
            rows = split.select("book", "sentence_id", *more, F.posexplode(each).alias("position", "__t"))
            rows = rows.select("book", "sentence_id", *more, "position", "__t.*")
        else:
            # Spread as it is found: for a named column the optimizer would infer a filter, and match the pattern again for it.
            rows = sentences.select("book", "sentence_id", *more, F.posexplode(words).alias("position", "surface"))
        return self._classified(rows, only)

    def nested(self, sentences: DataFrame) -> DataFrame:
        """(book, sentence_id, surfaces): a sentence's tokens as one list in their order, where it has any; none is tagged."""
        return _listed(sentences, F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0)))

    def _classified(self, rows: DataFrame, only: DataFrame | None = None) -> DataFrame:
        """``rows`` (surface, position, ..) with lemma, pos, is_stop and is_alpha."""
        known = self.irregulars if self.irregulars is not None else inflection.irregular(rows.sparkSession)
        fixed = known.select(F.col("form").alias("__w"), F.col("lemma").alias("__lemma"), F.col("pos").alias("__pos"))
        rows = rows.withColumn("__w", F.lower("surface"))
        if only is not None:
            rows = rows.join(F.broadcast(only.withColumnRenamed("form", "__w")), "__w")
        tagged = (
            rows.join(fixed, "__w", "left")
            .withColumn("pos", tag(F.col("surface"), F.col("__w"), F.col("position"), F.col("__pos")))
            .withColumn("is_stop", F.col("__w").isin(*lexicon.STOP_WORDS))
            .withColumn("is_alpha", _is_letter(F.substring("surface", 1, 1)) & ~F.contains("surface", F.lit("'")))
        )
        lemma = lemma_of(F.col("__w"), F.col("pos"), F.col("is_stop"), F.col("__lemma"))
        return tagged.withColumn("lemma", lemma).drop("__w", "__lemma", "__pos")

    def counted(self, sentences: DataFrame) -> DataFrame:
        """Different words with lemma, pos, is_stop, is_alpha and ``n``, how often each is met.

        What the rules say of a token follows from its surface and from whether it
        is the first of its sentence, so those are counted first, and each
        different word is classified once whatever its number of uses.  The counts
        are written to the shared folder, or filters on what the rules say would
        go down to every token.
        """
        words = sentences.select(F.posexplode(F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0))).alias("position", "surface"))
        inner = F.least("position", F.lit(1)).alias("position")
        counts = words.groupBy("surface", inner).agg(F.count(F.lit(1)).alias("n"))
        return self._classified(materialize(counts, "word-counts"))

    def uses(self, sentences: DataFrame, words: DataFrame) -> DataFrame:
        """(sentence_id, lemma) of the tokens that are one of ``words``, some rows of ``counted``; no other token is classified."""
        split = sentences.select("sentence_id", F.posexplode(F.regexp_extract_all("sentence", F.lit(TOKEN), F.lit(0))).alias("position", "surface"))
        met = split.withColumn("position", F.least("position", F.lit(1)))
        return met.join(words.select("surface", "position", "lemma"), ["surface", "position"]).select("sentence_id", "lemma")

    def tagged_words(self, words: Column) -> Column:
        """Words that follow another of their sentence as (word, pos)."""
        verbs = [form for form, lemma, pos in inflection.irregular_rows() if pos == "VERB"]

        def word(w: Column) -> Column:
            lower = F.lower(w)
            return F.struct(lower.alias("word"), tag(w, lower, F.lit(1), F.when(lower.isin(*verbs), "VERB")).alias("pos"))

        return F.transform(words, word)


class LoadedAnnotator:
    """Tokens by a model that each worker loads once, from batches of sentences.

    ``load`` returns a function from a sentence to (surface, lemma, pos) of its
    tokens; stop words and letters are judged by the engine.
    """

    _HELD: dict = {}

    def __init__(self, load: Callable[[], Callable[[str], list[tuple[str, str, str]]]]):
        self.load = load

    def _reader(self) -> Callable[[str], Column]:
        load, held = self.load, LoadedAnnotator._HELD

        @F.pandas_udf("array<struct<surface:string,lemma:string,pos:string>>")
        def read(texts: pd.Series) -> pd.Series:
            name = f"{load.__module__}.{load.__qualname__}"
            if name not in held:
                held[name] = load()
            return texts.map(held[name])

        return read

    def nested(self, sentences: DataFrame) -> DataFrame:
        """(book, sentence_id, surfaces): a sentence's tokens as one list in their order, where it has any."""
        return _listed(sentences, F.transform(self._reader()("sentence"), lambda t: t["surface"]))

    def tokens(self, sentences: DataFrame) -> DataFrame:
        rows = sentences.select("book", "sentence_id", F.posexplode(self._reader()("sentence")).alias("position", "t"))
        return rows.select(
            "book",
            "sentence_id",
            "position",
            "t.*",
            F.lower("t.surface").isin(*lexicon.STOP_WORDS).alias("is_stop"),
            F.col("t.surface").rlike(f"^[{LETTERS}]+$").alias("is_alpha"),
            F.lit(" ").alias("whitespace"),
        )


def plain_loader() -> Callable[[str], list[tuple[str, str, str]]]:
    """A stand-in for a model: the built-in pattern, every token a noun."""
    pattern = re.compile(TOKEN)
    return lambda sentence: [(w, w.lower(), "NOUN") for w in pattern.findall(sentence)]


def tokenize(docs: DataFrame, annotator: Annotator | None = None) -> DataFrame:
    """The tokens table of a table of documents."""
    return (annotator or RegexAnnotator()).tokens(sentences(docs))


def with_book(tokens: DataFrame, book: str) -> DataFrame:
    """Tokens of one book, in the order of columns of ``schemas.TOKENS``."""
    rest = [c for c in tokens.columns if c != "book"]
    return tokens.select(F.lit(book).alias("book"), *rest)


def reconstruct(tokens: DataFrame, keys: tuple[str, ...] = ("book", "sentence_id")) -> DataFrame:
    """Sentences from tokens in order of position; spaces between words where no white space is stored.

    Nested tokens (``surfaces``, a list a sentence) have none stored.
    """
    if "surfaces" in tokens.columns:
        return merged_lists(tokens, keys).select(*keys, F.trim(F.array_join("surfaces", " ")).alias("sentence"))
    require_columns(tokens, [*keys, "position", "surface"], "tokens")
    stored = "whitespace" in tokens.columns
    piece = F.concat("surface", F.coalesce("whitespace", F.lit(""))) if stored else F.col("surface")
    ordered = F.array_sort(F.collect_list(F.struct("position", piece.alias("piece"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["piece"]), "" if stored else " ")
    return tokens.groupBy(*keys).agg(F.trim(joined).alias("sentence"))


def merged_lists(nested: DataFrame, keys: tuple[str, ...] = ("book", "sentence_id")) -> DataFrame:
    """(keys, surfaces): nested tokens with one list for equal keys, in order of position.

    Lists are dealt out whole, so a token carries no key of its own, and as a string if no
    word holds a space, which takes half the room.  A key has one list unless
    ids repeat; then the lists are merged by position, as ``reconstruct`` does.
    """
    plain = F.coalesce(F.forall("surfaces", lambda w: ~F.contains(w, F.lit(" "))), F.lit(False))
    packed = F.struct(F.when(plain, F.array_join("surfaces", " ")).alias("text"), F.when(~plain, F.col("surfaces")).alias("words"))
    lists = nested.groupBy(*keys).agg(F.collect_list(packed).alias("__packed"))
    lists = lists.withColumn("__lists", F.transform("__packed", lambda x: F.coalesce(x["words"], F.split(x["text"], " ", -1))))
    placed = F.flatten(F.transform("__lists", lambda words: F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w")))))
    merged = F.transform(F.array_sort(placed), lambda x: x["w"])
    return lists.select(*keys, F.when(F.size("__lists") == 1, F.element_at("__lists", 1)).otherwise(merged).alias("surfaces"))


def running_offsets(counts: DataFrame, key: str, value: str, buckets: int = 256, ties: tuple[str, ...] = ()) -> DataFrame:
    """``counts`` with ``offset``: the sum of ``value`` over all rows of lesser ``key``, equal ones in order of ``ties``.

    Rows are dealt into ranges of the key by a quantile sketch.  Only the sums of
    the ranges, at most ``buckets`` + 1 rows, meet in one place.
    """
    cuts = sorted(set(counts.approxQuantile(key, [i / buckets for i in range(1, buckets)], 0.0005)))
    below = F.array(*[F.lit(float(c)) for c in cuts])
    bucket = F.size(F.filter(below, lambda c: c < F.col(key))) if cuts else F.lit(0)
    dealt = counts.withColumn("__bucket", bucket)
    sums = dealt.groupBy("__bucket").agg(F.sum(value).alias("__sum"))
    before = sums.select(
        "__bucket", (F.sum("__sum").over(Window.orderBy("__bucket")) - F.col("__sum")).alias("__before")
    )
    until = Window.partitionBy("__bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum(value).over(until) - F.col(value)
    return (
        dealt.withColumn("__own", own)
        .join(F.broadcast(before), "__bucket")
        .withColumn("offset", F.col("__before") + F.col("__own"))
        .drop("__bucket", "__own", "__before")
    )


def learnable(tokens: DataFrame, stop: bool = False, proper: bool = False, other: bool = False) -> DataFrame:
    """Tokens that count: no stop words, proper nouns or non-letters, unless admitted."""
    keep = F.lit(True)
    if not stop:
        keep = keep & ~F.col("is_stop")
    if not proper:
        keep = keep & (F.col("pos") != "PROPN")
    if not other:
        keep = keep & F.col("is_alpha")
    return tokens.where(keep)


def content(tokens: DataFrame) -> DataFrame:
    """Tokens of nouns, verbs, adjectives and adverbs, no stop words.

    Each token is spread as often as it counts, once or never: a filter would go below what the rules
    say and be made of their whole text, and they would run several times a token.
    """
    keep = F.col("is_alpha") & ~F.col("is_stop") & F.col("pos").isin(*lexicon.CONTENT_POS)
    return tokens.select("*", F.explode(F.when(keep, F.array(F.lit(1)))).alias("__kept")).drop("__kept")


def check_sentences(tokens: DataFrame, sentences: DataFrame) -> DataFrame:
    """Violations: (problem, sentence_id) of ids that repeat or that tokens name without a sentence."""
    repeated = sentences.groupBy("sentence_id").count().where("count > 1").select("sentence_id")
    orphans = tokens.select("sentence_id").distinct().join(sentences, "sentence_id", "left_anti")
    return repeated.select(F.lit("repeated").alias("problem"), "sentence_id").unionByName(
        orphans.select(F.lit("orphan").alias("problem"), "sentence_id")
    )
