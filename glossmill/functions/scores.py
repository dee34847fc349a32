"""Scores, classes and labels as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill import lexicon
from glossmill.functions.text import LETTERS


def rarity(zipf: Column, target: float = 4.0) -> Column:
    """A bell around the target frequency; null is 0."""
    return F.coalesce(F.exp(-F.pow(zipf.cast("double") - F.lit(target), 2) / 2), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, each norm raised by 1e-10."""

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / ((F.sqrt(dot(a, a)) + 1e-10) * (F.sqrt(dot(b, b)) + 1e-10))


def content_words(text: Column) -> Column:
    """Distinct lowered words of three letters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"[0-9_{LETTERS}]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in lexicon.STOP_WORDS])
    return F.array_except(F.filter(words, lambda w: (F.length(w) > 2) & w.rlike("^[a-z]+$")), stop)


def context_boost(gloss: Column, sentence: Column) -> Column:
    """Common content words over the smaller set, at most 0.5."""
    a, b = content_words(gloss), content_words(sentence)
    least = F.least(F.size(a), F.size(b))
    share = F.size(F.array_intersect(a, b)) / F.nullif(least, F.lit(0))
    return F.coalesce(F.least(share, F.lit(0.5)), F.lit(0.0))


def combined(similarity: Column, boost: Column, weight: float = 0.08) -> Column:
    """Similarity and weighted boost, kept within 0 and 1."""
    return F.least(F.greatest(similarity + weight * boost, F.lit(0.0)), F.lit(1.0))


def by_table(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """A lookup in a small fixed table."""
    chain = reduce(lambda c, kv: c.when(value == kv[0], F.lit(kv[1])), table.items(), F.when(F.lit(False), F.lit("")))
    return chain.otherwise(default if default is not None else F.lit(None).cast("string"))


def sense_pos(pos: Column) -> Column:
    """n, v, a or r for a tag of a content word, else null."""
    return by_table(F.upper(pos), lexicon.SENSE_POS)


def card_pos(name: Column) -> Column:
    """NOUN, VERB, ADJ or ADV for a name of a part of speech, else the empty string."""
    upper = F.upper(name)
    return by_table(F.lower(F.trim(name)), lexicon.CARD_POS, F.when(upper.isin(*lexicon.CONTENT_POS), upper).otherwise(F.lit("")))


def supersense(lexname: Column, synset: Column) -> Column:
    """The category of a sense; topmost nouns by their own table, others of them objects."""
    base = F.concat(F.lit("noun."), F.substring_index(synset, ".", 1))
    top = by_table(synset, lexicon.TOP_SENSES, F.when(base.isin(*lexicon.SENSES), base).otherwise(F.lit("noun.object")))
    known = F.when(lexname.isin(*lexicon.SENSES), lexname).when(lexname == "adj.pert", F.lit("adj.all"))
    return F.when(lexname == "noun.Tops", top).otherwise(F.coalesce(known, F.lit("unknown")))


def ignores_function_word(lemma: Column, override: Column | None = None) -> Column:
    """Whether a word is left out: an override decides first, then the list, else yes."""
    listed = F.when(F.lower(lemma).isin(*lexicon.KEPT_FUNCTION_WORDS), F.lit(False)).otherwise(F.lit(True))
    return F.coalesce(override, listed) if override is not None else listed


def pos_shares(counts: Column) -> Column:
    """'NOUN 71%, VERB 29%' of an array of (pos, n), by pos, halves to even."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c["n"])
    return F.array_join(
        F.transform(
            F.array_sort(counts),
            lambda c: F.concat(c["pos"], F.lit(" "), F.bround(c["n"] * 100 / total).cast("int").cast("string"), F.lit("%")),
        ),
        ", ",
    )


def sampling_difficulty(senses: Column, margin: Column) -> Column:
    """hard at seven senses or a margin below 0.15; easy at three or fewer and 0.3 or more."""
    return F.when((senses >= 7) | (margin < 0.15), "hard").when((senses <= 3) & (margin >= 0.3), "easy").otherwise("medium")


def evaluation_difficulty(senses: Column, margin: Column) -> Column:
    """easy at two or fewer senses and 0.3 or more; hard at six or a margin below 0.15."""
    n, m = F.coalesce(senses, F.lit(1)), F.coalesce(margin, F.lit(1.0))
    return F.when((n <= 2) & (m >= 0.3), "easy").when((n >= 6) | (m < 0.15), "hard").otherwise("medium")


def baseline_margin(senses: Column) -> Column:
    """1 for one sense or none, else two over their number, at most 0.5."""
    return F.when(senses <= 1, F.lit(1.0)).otherwise(F.least(F.lit(2.0) / senses, F.lit(0.5)))


def cost(input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column, factor: float = 1.0) -> Column:
    """Cost of a call at prices a million tokens."""
    return (input_tokens * price_in + output_tokens * price_out) / 1_000_000.0 * factor


def is_confident(confidence, least: float = 0.3):
    """Whether a sense was chosen with enough confidence; no confidence is not enough."""
    return F.coalesce(confidence >= least, F.lit(False))
