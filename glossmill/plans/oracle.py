"""Shared pieces of the DuckDB SQL that checks the queries."""

from __future__ import annotations

from glossmill import inflection, lexicon
from glossmill.functions.text import LETTERS
from glossmill.operators.tokens import DETERMINERS, JOINERS


def listed(words) -> str:
    """Words as a list of SQL string literals."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def regular_lemma(column: str) -> str:
    """The lemma of a lower-cased form by its ending, with the rules of the engine."""
    branches = []
    for last, rules in inflection.LEMMA_RULES.items():
        tests = "".join(
            f" WHEN regexp_matches({column}, {_quoted(pattern)}) THEN " + (f"substr({column}, 1, length({column}) - {cut}) || {_quoted(put)}" if cut or put else column)
            for pattern, cut, put in rules
        )
        branches.append(f" WHEN {column} LIKE '%{last}' THEN CASE{tests} END")
    return f"CASE WHEN NOT regexp_matches({column}, '^[a-z]+$') THEN {column}{''.join(branches)} ELSE {column} END"


IRREGULAR = "irr(form, irr_lemma, irr_pos) AS (VALUES " + ", ".join(f"('{f}', '{w}', '{p}')" for f, w, p in inflection.irregular_rows()) + ")"

SENTENCES = r"""
sent AS (
  SELECT CAST(doc_id AS VARCHAR) AS book, doc_id * 10000000 + unnest(range(len(ss))) AS sentence_id, unnest(ss) AS sentence
  FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), lambda x: trim(x, E' \t\r')),
               lambda x: x <> '') AS ss FROM documents))
"""

TOKENS = (
    SENTENCES
    + rf""", raw AS (
  SELECT book, sentence_id, CAST(unnest(range(len(ws))) AS INTEGER) AS position, unnest(ws) AS surface
  FROM (SELECT book, sentence_id, regexp_extract_all(sentence, '[{LETTERS}]+(?:''[a-z]+)?|[0-9]+|[^ \t\n\r\f\x0B0-9{LETTERS}]') AS ws FROM sent)),
@irregular@,
tagged AS (
  SELECT book, sentence_id, position, surface, lower(surface) AS w, irr_lemma,
    CASE WHEN regexp_matches(surface, '^[0-9]+$') THEN 'NUM'
         WHEN NOT regexp_matches(surface, '^[{LETTERS}]') THEN 'PUNCT'
         WHEN lower(surface) IN ({listed(DETERMINERS)}) THEN 'DET'
         WHEN lower(surface) IN ({listed(JOINERS)}) THEN 'CCONJ'
         WHEN lower(surface) IN ({listed([*lexicon.IGNORED_FUNCTION_WORDS, *lexicon.KEPT_FUNCTION_WORDS])}) THEN 'ADP'
         WHEN position > 0 AND regexp_matches(surface, '^[A-Z]') THEN 'PROPN'
         WHEN irr_pos IS NOT NULL THEN irr_pos
         WHEN regexp_matches(lower(surface), 'ly$') THEN 'ADV'
         WHEN regexp_matches(lower(surface), '(?:ing|ed)$') THEN 'VERB'
         WHEN regexp_matches(lower(surface), '(?:ble|ous|ful|ive|al)$') THEN 'ADJ'
         ELSE 'NOUN' END AS pos,
    lower(surface) IN ({listed(lexicon.STOP_WORDS)}) AS is_stop,
    regexp_matches(surface, '^[{LETTERS}]+$') AS is_alpha, ' ' AS whitespace
  FROM raw LEFT JOIN irr ON lower(surface) = form),
tok AS (
  SELECT book, sentence_id, position, surface,
    CASE WHEN pos = 'PROPN' THEN w WHEN irr_lemma IS NOT NULL THEN irr_lemma
         WHEN is_stop OR pos NOT IN ('NOUN', 'VERB', 'ADJ', 'ADV') THEN w ELSE @regular@ END AS lemma, pos, is_stop, is_alpha, whitespace
  FROM tagged)
""".replace("@irregular@", IRREGULAR).replace("@regular@", regular_lemma("w"))
)

FREQUENCY = (
    TOKENS
    + """, freq AS (
  SELECT lemma, count(*) AS book_freq, count(DISTINCT sentence_id) AS doc_count,
         count(*) FILTER (pos = 'VERB') AS verb_count, count(*) FILTER (pos <> 'VERB') AS other_pos_count,
         count(*) FILTER (is_stop) AS stopword_count
  FROM tok WHERE NOT is_stop AND pos <> 'PROPN' AND is_alpha GROUP BY lemma)
"""
)

ZIPF = (
    FREQUENCY
    + """, words AS (
  SELECT lemma, log10(count(*) / CAST((SELECT count(*) FROM tok WHERE is_alpha) AS DOUBLE) * 1e9) AS zipf
  FROM tok WHERE is_alpha GROUP BY lemma),
zipfed AS (SELECT freq.*, coalesce(zipf, 0.0) AS global_zipf FROM freq LEFT JOIN words USING (lemma)),
kept AS (SELECT * FROM zipfed WHERE book_freq >= 3 AND global_zipf >= 2.0 AND global_zipf <= 5.5),
scored AS (SELECT *, book_freq / CAST((SELECT max(book_freq) FROM kept) AS DOUBLE) * exp(-pow(global_zipf - 4.0, 2) / 2) AS score FROM kept)
"""
)
