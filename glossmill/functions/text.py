"""Text clean-up and matching as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill import lexicon

#: Letters of the built-in tokenizer.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_BLANKS = "[ \\t\\x0B\\f\\r]"


def normalize_headers(text: Column) -> Column:
    """A full stop after lines that are only a book, chapter or part number, a roman or a plain number."""
    edge = "[ \\t\\x0B\\f\\r]*"
    named = F.regexp_replace(text, f"(?dim)^{edge}(book|chapter|part)[ \\t]+([ivxlcdm]+|[0-9]+){edge}$", "$1 $2.")
    roman = F.regexp_replace(named, f"(?dim)^{edge}([ivxlcdm]+){edge}$", "$1.")
    return F.regexp_replace(roman, f"(?dm)^{edge}([0-9]+){edge}$", "$1.")


def preprocess(text: Column, newlines: bool = True) -> Column:
    """Clean text for tokenising.

    Byte-order marks, zero-width spaces and soft hyphens go; dashes get spaces;
    double quotes and the acute accent become plain; headers get full stops; line
    ends are unified, blank runs cut to one empty line and line ends trimmed.  A
    curly apostrophe stays as it is.
    """
    plain = F.translate(text, "﻿​­", "")
    plain = F.regexp_replace(plain, "[—–]", " - ")
    plain = F.translate(plain, "“”„«»´", "\"\"\"\"\"'")
    plain = normalize_headers(plain)
    if not newlines:
        return F.regexp_replace(plain, "\\s+\\z", "")
    plain = F.regexp_replace(plain, "\\r\\n?", "\n")
    plain = F.regexp_replace(plain, "\\n{3,}", "\n\n")
    plain = F.regexp_replace(plain, f"{_BLANKS}+(?=\\n)", "")
    return F.regexp_replace(plain, "\\A\\s+|\\s+\\z", "")


def quote_spacing(sentence: Column) -> Column:
    """No space inside double quotes; an edge quote goes if their number is odd."""
    s = F.regexp_replace(sentence, '"\\s+([A-Za-z0-9])', '"$1')
    s = F.regexp_replace(s, "“\\s+([A-Za-z0-9])", "“$1")
    s = F.regexp_replace(s, '([A-Za-z0-9.,;:!?])\\s+"', '$1"')
    s = F.regexp_replace(s, "([A-Za-z0-9.,;:!?])\\s+”", "$1”")
    odd = F.length(F.regexp_replace(s, '[^"“”]', "")) % 2 == 1
    bare = F.regexp_replace(F.regexp_replace(s, '\\A\\s*["“]\\s*', ""), '\\s*["”]\\s*\\z', "")
    return F.when(odd, bare).otherwise(s)


def normalize_for_matching(text: Column) -> Column:
    """Plain apostrophes, dashes and spaces, runs of white space as one; no compatibility folding."""
    s = F.translate(F.coalesce(text, F.lit("")), "’‘′—– ", "'''-- ")
    return F.regexp_replace(F.regexp_replace(s, "(?U)\\s+", " "), "\\A | \\z", "")


def expand_contractions(text: Column) -> Column:
    """Common English contractions written out, in order."""
    return reduce(lambda s, c: F.regexp_replace(s, f"(?i)\\b{c[0]}\\b", c[1]), lexicon.CONTRACTIONS, text)


def _quoted(word: Column) -> Column:
    return F.concat(F.lit("(?i)\\b\\Q"), F.replace(word, F.lit("\\E"), F.lit("")), F.lit("\\E\\b"))


def word_in_text(word: Column, text: Column) -> Column:
    """Whether a word stands in a text, contractions as written or expanded."""
    return word_in_forms(word, *matching_forms(text))


def matching_forms(text: Column) -> tuple[Column, Column]:
    """A text as words are looked for in it, and its contractions written out, null where it has no apostrophe.

    For many words of one text these are made once and given to ``word_in_forms``.
    """
    plain = F.when(F.length(text) > 0, normalize_for_matching(text))
    return plain, F.when(F.contains(plain, F.lit("'")), expand_contractions(plain))


def word_in_forms(word: Column, plain: Column, expanded: Column) -> Column:
    """``word_in_text`` of the two forms of a text."""
    found = F.regexp(plain, _quoted(word)) | F.coalesce(F.regexp(expanded, _quoted(word)), F.lit(False))
    return F.when((F.length(word) > 0) & plain.isNotNull(), found).otherwise(F.lit(False))


def target_in_text(target: Column, text: Column) -> Column:
    """A phrase matches as part of the lowered text, a single word as a whole word."""
    trimmed = F.trim(target)
    phrase = F.contains(F.lower(normalize_for_matching(text)), F.lower(normalize_for_matching(trimmed)))
    both = (F.length(trimmed) > 0) & (F.length(text) > 0)
    return F.when(~both, F.lit(False)).when(F.contains(trimmed, F.lit(" ")), phrase).otherwise(word_in_text(trimmed, text))


def strip_fences(text: Column) -> Column:
    """JSON text without the fences of a code block."""
    s = F.regexp_replace(text, "\\A\\s*```[A-Za-z]*\\s*\\n?", "")
    return F.trim(F.regexp_replace(s, "\\n?\\s*```\\s*\\z", ""))


def repair_json(text: Column) -> Column:
    """The outermost braces of a fenced text, without commas before closing brackets."""
    body = F.regexp_extract(strip_fences(text), "(?s)(\\{.*\\})", 1)
    return F.regexp_replace(body, ",(\\s*[}\\]])", "$1")
