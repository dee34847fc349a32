"""English inflection as rules: from words to their forms, and from forms back to words.

Regular forms follow from endings.  Irregular ones follow from classes of verbs
and nouns that change alike; a class is an ending of the word, the endings it
turns into, and its members.  ``irregular_rows`` spells them out as a small fixed
table (form, lemma, pos), which a caller can extend or replace.

``LEMMA_RULES`` is a trie of endings, tried from the longest class of a word's
last letters down: the rows of the last letters are tried in order, the first
pattern that matches gives the lemma.  The patterns hold no look-around, so other
engines read them alike.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossmill.schemas import fixed_table

#: Verbs by what they turn into: ending, past, participle, verbs.
VERB_CLASSES = (
    ("ing", "ang", "ung", ("ring", "sing", "spring")),
    ("ink", "ank", "unk", ("drink", "shrink", "sink", "stink")),
    ("in", "an", "un", ("begin",)),
    ("im", "am", "um", ("swim",)),
    ("un", "an", "un", ("run", "outrun", "overrun")),
    ("ing", "ung", "ung", ("cling", "fling", "sling", "sting", "string", "swing", "wring")),
    ("in", "un", "un", ("spin",)),
    ("ink", "unk", "unk", ("slink",)),
    ("ick", "uck", "uck", ("stick",)),
    ("ike", "uck", "uck", ("strike",)),
    ("ig", "ug", "ug", ("dig",)),
    ("ang", "ung", "ung", ("hang", "overhang")),
    ("in", "on", "on", ("win",)),
    ("ine", "one", "one", ("shine",)),
    ("ow", "ew", "own", ("blow", "grow", "know", "throw", "outgrow", "overthrow")),
    ("y", "ew", "own", ("fly",)),
    ("aw", "ew", "awn", ("draw", "withdraw")),
    ("ay", "ew", "ain", ("slay",)),
    ("ear", "ore", "orn", ("bear", "swear", "tear", "wear", "shear")),
    ("eak", "oke", "oken", ("break", "speak")),
    ("eal", "ole", "olen", ("steal",)),
    ("eave", "ove", "oven", ("weave", "cleave")),
    ("eeze", "oze", "ozen", ("freeze",)),
    ("oose", "ose", "osen", ("choose",)),
    ("ake", "oke", "oken", ("wake", "awake")),
    ("ake", "ook", "aken", ("take", "shake", "forsake", "mistake", "overtake", "partake", "undertake")),
    ("ide", "ode", "idden", ("ride", "override", "stride")),
    ("ide", "id", "idden", ("hide",)),
    ("ide", "id", "id", ("slide",)),
    ("ide", "ode", "ode", ("abide",)),
    ("ite", "ote", "itten", ("write", "rewrite", "smite")),
    ("ite", "it", "itten", ("bite",)),
    ("ive", "ove", "iven", ("drive", "strive", "thrive")),
    ("ive", "ave", "iven", ("give", "forgive")),
    ("ise", "ose", "isen", ("rise", "arise")),
    ("ind", "ound", "ound", ("bind", "find", "grind", "wind", "unwind")),
    ("ight", "ought", "ought", ("fight",)),
    ("ight", "it", "it", ("light", "alight")),
    ("eek", "ought", "ought", ("seek",)),
    ("ing", "ought", "ought", ("bring",)),
    ("ink", "ought", "ought", ("think", "rethink")),
    ("uy", "ought", "ought", ("buy",)),
    ("each", "aught", "aught", ("teach",)),
    ("atch", "aught", "aught", ("catch",)),
    ("eep", "ept", "ept", ("creep", "keep", "oversleep", "sleep", "sweep", "weep")),
    ("eel", "elt", "elt", ("feel", "kneel")),
    ("", "t", "t", ("burn", "deal", "dream", "lean", "leap", "learn", "mean", "spoil")),
    ("ll", "lt", "lt", ("dwell", "smell", "spell", "spill")),
    ("d", "t", "t", ("bend", "build", "lend", "rebuild", "send", "spend")),
    ("eave", "eft", "eft", ("leave",)),
    ("ose", "ost", "ost", ("lose",)),
    ("ell", "old", "old", ("foretell", "sell", "tell")),
    ("", "d", "d", ("hear", "overhear")),
    ("ay", "aid", "aid", ("lay", "mislay", "pay", "repay", "say")),
    ("ee", "aw", "een", ("foresee", "oversee", "see")),
    ("ee", "ed", "ed", ("flee",)),
    ("eed", "ed", "ed", ("bleed", "breed", "feed", "speed")),
    ("ead", "ed", "ed", ("lead", "mislead")),
    ("eet", "et", "et", ("meet",)),
    ("oot", "ot", "ot", ("shoot",)),
    ("old", "eld", "eld", ("behold", "hold", "uphold", "withhold")),
    ("et", "ot", "otten", ("beget", "forget", "get")),
    ("ead", "od", "odden", ("tread",)),
    ("it", "at", "at", ("sit", "spit")),
    ("and", "ood", "ood", ("misunderstand", "stand", "understand", "withstand")),
    ("all", "ell", "allen", ("befall", "fall")),
    ("eat", "ate", "eaten", ("eat", "overeat")),
    ("eat", "eat", "eaten", ("beat",)),
    ("ell", "elled", "ollen", ("swell",)),
    ("ome", "ame", "ome", ("become", "come", "overcome")),
    ("id", "ade", "idden", ("forbid",)),
    ("go", "went", "gone", ("go", "forgo", "undergo")),
    ("o", "id", "one", ("do", "overdo", "redo", "undo")),
    ("ake", "ade", "ade", ("make", "remake")),
    ("ave", "ad", "ad", ("have",)),
    ("ie", "ay", "ain", ("lie",)),
    ("", "ed", "n", ("hew", "mow", "saw", "sew", "show", "sow", "strew")),
    ("", "d", "n", ("prove", "shave")),
    ("", "", "", ("bet", "bid", "burst", "cast", "cost", "cut", "hit", "hurt", "knit", "let", "put", "quit", "read", "rid")),
    ("", "", "", ("set", "shed", "shut", "slit", "split", "spread", "thrust", "upset", "wed", "wet")),
)
#: Nouns by their plural: ending, plural ending, nouns.
NOUN_CLASSES = (
    ("an", "en", ("gentleman", "man", "policeman", "woman", "workman")),
    ("oot", "eet", ("foot",)),
    ("ooth", "eeth", ("tooth",)),
    ("oose", "eese", ("goose",)),
    ("ouse", "ice", ("louse", "mouse")),
    ("ie", "ice", ("die",)),
    ("erson", "eople", ("person",)),
    ("", "ren", ("child",)),
    ("", "en", ("ox",)),
    ("f", "ves", ("calf", "elf", "half", "leaf", "loaf", "self", "shelf", "thief", "wolf")),
    ("fe", "ves", ("knife", "life", "wife")),
)
#: Words whose forms share little, with their part of speech.
SUPPLETIVE = (
    ("be", "VERB", ("am", "is", "are", "was", "were", "been", "being")),
    ("have", "VERB", ("has", "having")),
    ("do", "VERB", ("does", "doing")),
    ("go", "VERB", ("goes",)),
    ("die", "VERB", ("dying",)),
    ("lie", "VERB", ("lying",)),
    ("tie", "VERB", ("tying",)),
    ("free", "VERB", ("freed", "freeing")),
    ("agree", "VERB", ("agreed", "agreeing")),
    ("focus", "VERB", ("focused", "focusing")),
    ("bus", "NOUN", ("buses",)),
    ("gas", "NOUN", ("gases",)),
    ("ache", "VERB", ("aches",)),
    ("good", "ADJ", ("better", "best")),
    ("bad", "ADJ", ("worse", "worst")),
    ("far", "ADJ", ("farther", "farthest", "further", "furthest")),
)
#: Words that only look inflected.
UNCHANGED = (
    ("NOUN", ("morning", "evening", "nothing", "something", "anything", "everything", "ceiling", "wedding", "pudding", "sibling", "lightning")),
    ("NOUN", ("hundred", "hatred", "kindred", "news", "lens", "series", "species", "means", "christmas", "canvas", "atlas", "bias", "gas", "bus")),
    ("ADJ", ("naked", "sacred", "wicked", "rugged")),
    ("ADV", ("always", "perhaps", "besides", "afterwards", "sometimes", "indeed", "alas", "thus", "yes")),
)

#: Of a word that ends as the first says, some last letters are cut and endings put on: (pattern, cut, endings).
FORM_RULES = (
    ("", 0, ("", "s", "es", "ed", "ing", "er", "est")),
    ("e$", 0, ("d", "r", "st")),
    ("e$", 1, ("ing",)),
    ("..y$", 1, ("ied", "ies", "ier", "iest")),
)
#: Words whose last letter is doubled before these endings.
DOUBLING, DOUBLED = ".[aeiou][^aeiouwy]$", ("ing", "ed")

#: Ends of what is left of a form without -ed or -ing where the word itself ends in e.
SILENT_E = (
    "[cuvz]|[^s]s|dg|rg|(?:ch|r|ll|v)[ae]ng|[bcdfgkptz]l|[^aeou]in|[^aeo]ir|[^aeo]ur|[^aeo]or|[^aeo]id|ag|"
    "(?:cre|[^eo])at|[vn]it|xcit|ecit|plet|elet|quot|mot|evot|[^aeiou]ut|^[thpw]ast|^[^aeiou]*[aeiouy][^aeiouwxy]"
)
#: Last letters of a form -> (pattern, letters cut, letters put on), tried in order; none: the form itself.
LEMMA_RULES = {
    "s": (
        ("^.?.?.$|(?:ss|us|is)$", 0, ""),
        ("^.ies$", 1, ""),
        ("ies$", 3, "y"),
        ("(?:ss|x|zz|ch|sh|...o)es$", 2, ""),
        ("$", 1, ""),
    ),
    "ed": (
        ("^.?.?.?$|eed$|^[^aeiouy]*ed$", 0, ""),
        ("^.ied$", 1, ""),
        ("ied$", 3, "y"),
        ("[aeiouy][^aeiou]+[eo]lled$", 3, ""),
        ("^[aeo](?:dd|gg|rr)ed$|(?:ff|ll|ss|zz)ed$", 2, ""),
        ("(?:bb|dd|gg|mm|nn|pp|rr|tt)ed$", 3, ""),
        (f"(?:{SILENT_E}|^ach)ed$", 1, ""),
        ("$", 2, ""),
    ),
    "ing": (
        ("^[^aeiouy]*ing$", 0, ""),
        ("[aeiouy][^aeiou]+[eo]lling$", 4, ""),
        ("^[aeo](?:dd|gg|rr)ing$|(?:ff|ll|ss|zz)ing$", 3, ""),
        ("(?:bb|dd|gg|mm|nn|pp|rr|tt)ing$", 4, ""),
        (f"(?:{SILENT_E}|^ach)ing$", 3, "e"),
        ("$", 3, ""),
    ),
}


def irregular_rows() -> list[tuple[str, str, str]]:
    """(form, lemma, pos) of every irregular form; a form of several words goes to the first.

    A form that is itself a word of a class (``lay``, ``saw``, ``found``) stays that
    word only if it is listed as one; unchanged forms are not repeated.
    """
    rows: dict[str, tuple[str, str]] = {}
    bases = {verb for *_, verbs in VERB_CLASSES for verb in verbs}
    for ending, past, participle, verbs in VERB_CLASSES:
        for verb in verbs:
            for new in (past, participle):
                form = verb[: len(verb) - len(ending)] + new
                if form not in bases or form == "saw":
                    rows.setdefault(form, (verb, "VERB"))
    for ending, plural, nouns in NOUN_CLASSES:
        for noun in nouns:
            rows.setdefault(noun[: len(noun) - len(ending)] + plural, (noun, "NOUN"))
    for lemma, pos, forms in SUPPLETIVE:
        for form in forms:
            rows.setdefault(form, (lemma, pos))
    for pos, words in UNCHANGED:
        for word in words:
            rows.setdefault(word, (word, pos))
    return [(form, *found) for form, found in rows.items()]


def irregular(spark: SparkSession, more: Iterable[tuple[str, str, str]] = ()) -> DataFrame:
    """The irregular dimension (form, lemma, pos), rows of ``more`` in place of built-in ones of the same form."""
    rows = {row[0]: row for row in [*irregular_rows(), *more]}
    return fixed_table(spark, rows.values(), "form string, lemma string, pos string")


def regular_lemma(form: Column) -> Column:
    """The lemma of a lower-cased form by its ending; short words and other endings stay."""
    found, plain = form, form.rlike("^[a-z]+$")
    for last, rules in LEMMA_RULES.items():
        branch = F.lit(None).cast("string")
        for pattern, cut, put in reversed(rules):
            lemma = F.concat(F.substring(form, F.lit(1), F.length(form) - cut), F.lit(put)) if cut or put else form
            branch = F.when(form.rlike(pattern), lemma).otherwise(branch) if pattern != "$" else lemma
        found = F.when(F.endswith(form, F.lit(last)), F.when(plain, branch).otherwise(form)).otherwise(found)
    return found


def word_forms(lemma: Column) -> Column:
    """Regular forms of a word, as a distinct array: verb, noun and adjective endings alike."""
    w = F.lower(lemma)
    none = F.expr("cast(array() as array<string>)")

    def put(stem: Column, endings: tuple[str, ...]) -> Column:
        return F.array(*(F.concat(stem, F.lit(e)) for e in endings))

    parts = []
    for pattern, cut, endings in FORM_RULES:
        forms = put(F.substring(w, F.lit(1), F.length(w) - cut) if cut else w, endings)
        parts.append(F.when(w.rlike(pattern), forms).otherwise(none) if pattern else forms)
    parts.append(F.when(w.rlike(DOUBLING), put(F.concat(w, F.substring(w, -1, 1)), DOUBLED)).otherwise(none))
    return F.array_distinct(F.concat(*parts))


def irregular_forms(lemma: Column) -> Column:
    """The built-in irregular forms of a word as an array, from a constant map; for the few words of cards."""
    own: dict[str, list[str]] = {}
    for form, word, _ in irregular_rows():
        if form != word:
            own.setdefault(word, []).append(form)
    entries = [F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for entry in own.items() for x in entry]
    found = F.try_element_at(F.create_map(*entries), F.lower(lemma))
    return F.coalesce(found, F.expr("cast(array() as array<string>)"))


def all_forms(words: DataFrame, irregulars: DataFrame) -> DataFrame:
    """``words`` (lemma, ..) with forms: the regular ones and those of the irregular dimension, sorted.

    The dimension is grouped by lemma before the join, so a word meets one row.
    """
    own = irregulars.where("form <> lemma").groupBy(F.col("lemma").alias("__lemma")).agg(F.collect_set("form").alias("__irregular"))
    joined = words.join(own, F.lower("lemma") == F.col("__lemma"), "left")
    both = F.array_union(word_forms(F.col("lemma")), F.coalesce("__irregular", F.expr("cast(array() as array<string>)")))
    return joined.withColumn("forms", F.array_sort(both)).drop("__lemma", "__irregular")


def lemma_index(words: DataFrame, irregulars: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(form, lemma) of every different word that is a form of another: the inverse of ``all_forms``.

    ``words`` has a column form, lower-cased, one row a different word.  Every
    possible word of the index is inflected by the rules of ``word_forms``, and
    forms are joined back to what they come from, so a lemma is always a word
    that is attested: one of ``known`` (lemma), or of ``words`` itself where no
    list is given.  Of several, an irregular one wins, then the one that the
    rules of endings name, then the longest, then the first by name.  Each
    different word is inflected and joined once, whatever its number of uses.
    A form that the rules of endings read as the word with an e (``hoping``) is
    none of the word without (``hop``).
    """
    bases = (known.select(F.lower("lemma").alias("lemma")) if known is not None else words.select(F.col("form").alias("lemma"))).distinct()
    inflected = bases.where(F.length("lemma") > 2).select("lemma", F.explode(word_forms(F.col("lemma"))).alias("form"))
    other = (F.col("form") != F.col("lemma")) & (regular_lemma(F.col("form")) != F.concat("lemma", F.lit("e")))
    regular = words.select("form").join(inflected.where(other), "form").select("form", "lemma", F.lit(0).alias("__kind"))
    fixed = words.select("form").join(irregulars.select("form", "lemma"), "form").select("form", "lemma", F.lit(1).alias("__kind"))
    order = Window.partitionBy("form").orderBy(
        F.desc("__kind"), F.desc((F.col("lemma") == regular_lemma(F.col("form"))).cast("int")), F.desc(F.length("lemma")), "lemma"
    )
    ranked = regular.unionByName(fixed).withColumn("__n", F.row_number().over(order))
    return ranked.where("__n = 1").select("form", "lemma")
