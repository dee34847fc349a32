"""Phrasal verbs and other expressions of several words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill import inflection
from glossmill.functions.text import expand_contractions, normalize_for_matching, target_in_text
from glossmill.operators.tokens import RegexAnnotator

#: Most keys of headwords that go into a plan as literals.
_FEW = 200
#: Words that may stand between a verb and its particle.
GAP = 5
#: Parts of speech of an object between the two, and those that can end it.
OBJECT = ("DET", "ADJ", "NUM", "NOUN", "PRON", "PROPN")
OBJECT_END = ("NUM", "NOUN", "PRON", "PROPN")


def particle_place(ahead: Column, particles: Column) -> Column:
    """The place, from 1, of the first of ``particles`` that a verb reaches in the words ahead of it, else null.

    A particle is reached next to the verb or behind a whole object: words that
    can be in one, the last of which can end one.  The words ahead are read as
    bits, so all places are tried at once: ``inner + 1`` carries through the run
    of object words from the verb on, and the lowest bit left is the first hit.
    """

    def bits(test) -> Column:
        marked = F.transform(ahead, lambda x, i: F.when(test(x), F.pow(F.lit(2), i)).otherwise(0.0))
        return F.aggregate(marked, F.lit(0.0), lambda a, x: a + x).cast("long")

    found = bits(lambda x: F.array_contains(particles, x["word"]))
    inner = bits(lambda x: x["pos"].isin(*OBJECT))
    ends = bits(lambda x: x["pos"].isin(*OBJECT_END))
    reached = inner.bitwiseXOR(inner + 1)
    hits = found.bitwiseAND(reached).bitwiseAND(F.shiftleft(ends, 1).bitwiseOR(F.lit(1)))
    first = hits.bitwiseAND(-hits)
    return F.when(hits != 0, F.bit_count(first - 1) + 1)


def _phrases(rows: DataFrame, ahead: Column, keys: list[str]) -> DataFrame:
    """(keys, __at, verb, particle): the particle that each verb of ``rows`` (with ``particles``) reaches first.

    The words ahead are bound once, in a lambda, so they are tagged once however
    often the automaton looks at them, and the generator keeps filters above it.
    """

    def reached(words: Column) -> Column:
        return F.struct(F.element_at(words, particle_place(words, F.col("particles")))["word"].alias("particle"))

    found = F.filter(F.transform(F.array(ahead), reached), lambda x: x["particle"].isNotNull())
    return rows.select(*keys, F.col("position").alias("__at"), "verb", F.inline(found))


def _dictionary(pairs: DataFrame) -> DataFrame:
    """(lemma, particles): the particles of each verb of a dictionary in one row."""
    return pairs.groupBy(F.col("verb").alias("lemma")).agg(F.collect_set("particle").alias("particles"))


def _verb_forms(pairs: DataFrame) -> DataFrame:
    """(form, verb, particles): every form that a verb of a dictionary may have, right or not; the lemma decides."""
    own = _dictionary(pairs)
    forms = inflection.all_forms(own, inflection.irregular(pairs.sparkSession))
    return forms.select(F.explode("forms").alias("form"), F.col("lemma").alias("verb"), "particles")


#: A token of a form of a verb is that verb, and no name.
_IS_VERB = "CASE WHEN lemma = verb THEN pos NOT IN ('PROPN', 'DET') ELSE false END"


def _near() -> Column:
    """Whether any particle of a verb is among the words ahead of it; most verbs have none, and nothing is tagged for them."""
    return F.arrays_overlap(F.transform("words", lambda w: F.lower(w)), "particles")


def _named(found: DataFrame, *more: str) -> DataFrame:
    phrase = F.concat_ws(" ", "verb", "particle").alias("phrasal")
    return found.select("book", "sentence_id", phrase, "verb", "particle", *more).dropDuplicates(["book", "sentence_id", "phrasal"])


def phrasal_verbs(sentences: DataFrame, pairs: DataFrame, gap: int = GAP, annotator: RegexAnnotator | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """(book, sentence_id, phrasal, verb, particle) and columns ``more`` of sentences: verbs of a dictionary with their particles, objects between or not.

    Verbs are found by lemma in every form, and each takes the first particle of
    its own that it reaches ("gave the old lamp up"); each phrase counts once a
    sentence.  Every word brings the few words ahead of it along, so nothing is
    shuffled but the phrases found.  ``pairs`` has verb and particle.
    """
    own = annotator or RegexAnnotator()
    rows = own.rows(sentences, *more, ahead=gap + 1, only=_verb_forms(pairs)).where(_IS_VERB).where(_near())
    return _named(_phrases(rows, own.tagged_words(F.col("words")), ["book", "sentence_id", *more]), *more)


def phrasal_verbs_of_tokens(tokens: DataFrame, pairs: DataFrame, gap: int = GAP, verbs_only: bool = True) -> DataFrame:
    """``phrasal_verbs`` of a stored tokens table, with the lemmas and tags it has, from a model or the built-in rules.

    The words ahead come from a window over the sentence, which ``tokens`` must
    hold whole.  A model's tags say what is a verb; ``verbs_only`` asks for that.
    """
    window = Window.partitionBy("book", "sentence_id").orderBy("position").rowsBetween(1, gap + 1)
    ahead = F.collect_list(F.struct(F.lower("surface").alias("word"), "pos")).over(window)
    rows = tokens.select("book", "sentence_id", "position", "lemma", "pos", ahead.alias("__next")).join(_dictionary(pairs), "lemma").withColumnRenamed("lemma", "verb")
    if verbs_only:
        rows = rows.where("pos = 'VERB'")
    return _named(_phrases(rows, F.col("__next"), ["book", "sentence_id"]))


def phrases_of_items(items: DataFrame, pairs: DataFrame, item: str = "item", gap: int = GAP, annotator: RegexAnnotator | None = None) -> DataFrame:
    """(item, verb, particle): the first phrasal verb of the dictionary that an item's word is the verb of.

    ``items`` has item, lemma and sentence; the dictionary is searched in the
    item's own sentence, whatever form the word has there.
    """
    own = annotator or RegexAnnotator()
    texts = items.select(F.lit("").alias("book"), F.col(item).alias("sentence_id"), F.col("lemma").alias("__target"), "sentence")
    rows = own.rows(texts, "__target", ahead=gap + 1, only=_verb_forms(pairs)).where("verb = __target").where(_IS_VERB).where(_near())
    found = _phrases(rows, own.tagged_words(F.col("words")), ["sentence_id"])
    first = found.groupBy(F.col("sentence_id").alias(item)).agg(F.min_by(F.struct("verb", "particle"), "__at").alias("p"))
    return first.select(item, "p.verb", "p.particle")


def phrase_stats(phrases: DataFrame, kind: str = "phrasal_verb") -> DataFrame:
    """(phrasal, book_freq, item_type): sentences of each phrase."""
    return phrases.groupBy("phrasal").agg(F.count(F.lit(1)).alias("book_freq")).withColumn("item_type", F.lit(kind))


def candidates(stats: DataFrame, phrases: DataFrame, most: int = 10, source: str = "dictionary") -> DataFrame:
    """(headword, type, count, sample_sentence_ids, source) with the first ``most`` sentences of each phrase.

    ``source`` tells how phrases were found: the built-in way is a dictionary, not a parse.
    """
    first = Window.partitionBy("phrasal").orderBy("sentence_id")
    kept = phrases.select("phrasal", "sentence_id").distinct().withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= most)
    samples = kept.groupBy("phrasal").agg(F.array_sort(F.collect_list("sentence_id")).alias("ids"))
    return stats.join(samples, "phrasal", "left").select(
        F.col("phrasal").alias("headword"),
        F.lit("phrasal").alias("type"),
        F.col("book_freq").alias("count"),
        F.coalesce("ids", F.expr("cast(array() as array<bigint>)")).alias("sample_sentence_ids"),
        F.lit(source).alias("source"),
    )


def deck(candidates: DataFrame, kind: str = "phrasal", top_k: int = 0) -> DataFrame:
    """Candidates of a type by count; the first ``top_k``, all if that is not positive."""
    rows = candidates.where(F.col("type") == kind)
    return rows.orderBy(F.desc("count"), "headword").limit(top_k) if top_k > 0 else rows


def sentences_with(headwords: DataFrame, sentences: DataFrame, most: int = 10) -> DataFrame:
    """(headword, sentence_id, sentence): the first ``most`` sentences in which a headword stands.

    A single word is found by the first run of word characters it shares, a
    phrase by the letters around its first space; the exact test follows on those
    pairs alone, so no headword meets every sentence.  Up to ``_FEW`` keys of
    headwords are held against a sentence's own before those are spread to rows.
    """
    plain = normalize_for_matching(F.col("sentence"))
    written_out = F.when(F.contains(plain, F.lit("'")), F.concat_ws(" ", plain, expand_contractions(plain))).otherwise(plain)
    runs = F.regexp_extract_all(F.lower(written_out), F.lit("(?U)\\w+"), F.lit(0))
    heads = headwords.select("headword", F.lower(normalize_for_matching(F.trim("headword"))).alias("__h"))
    several = F.contains(F.col("__h"), F.lit(" "))
    single = heads.where(~several).select("headword", F.regexp_extract("__h", "(?U)(\\w+)", 1).alias("__key"))
    pair = heads.where(several).select("headword", F.regexp_extract("__h", "(. .)", 1).alias("__key"))
    gaps = F.regexp_extract_all(F.lower(plain), F.lit("(?=(. .))"), F.lit(1))

    def met_by(found, keys: DataFrame) -> DataFrame:
        few = [r[0] for r in keys.select("__key").distinct().limit(_FEW + 1).collect()]
        own = F.array_distinct(found) if len(few) > _FEW else F.array_intersect(found, F.array(*map(F.lit, few)).cast("array<string>"))
        return sentences.select("sentence_id", "sentence", F.explode(own).alias("__key")).join(keys, "__key")

    pairs = met_by(runs, single).unionByName(met_by(gaps, pair)).drop("__key")
    met = pairs.where(target_in_text(F.col("headword"), F.col("sentence")))
    first = Window.partitionBy("headword").orderBy("sentence_id")
    return met.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= most).drop("__n")
