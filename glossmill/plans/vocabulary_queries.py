"""Queries over vocabularies: statistics, filters, ranking, examples, phrases and known words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill import lexicon
from glossmill.operators import examples, known, mwe, stats, tokens
from glossmill.plans import oracle
from glossmill.plans.base import Registry, table
from glossmill.plans.text_queries import PHRASES, phrases
from glossmill.sources.shared import materialize

query = Registry()
QUERIES, ORACLES = query.queries, query.sql


def _tokens(spark, sf_dir) -> DataFrame:
    return tokens.tokenize(table(spark, sf_dir, "documents"))


def _words(spark, sf_dir) -> DataFrame:
    return tokens.RegexAnnotator().counted(tokens.sentences(table(spark, sf_dir, "documents")))


def _stats(spark, sf_dir) -> DataFrame:
    return stats.word_frequency_with_zipf(_words(spark, sf_dir))


def _ranked(spark, sf_dir) -> DataFrame:
    return stats.ranked(stats.by_frequency(_stats(spark, sf_dir)))


_KNOWN = ("the", "was", "edon", "thion", "inre", "ofthe")


def _known(spark) -> DataFrame:
    rows = [(w, ("known", "learning", "ignore", "maybe")[i % 4], "word", "", "") for i, w in enumerate(_KNOWN)]
    return spark.createDataFrame([*rows, ("the", "learning", "word", "", "")], "lemma string, status string, item_type string, tags string, synset_id string")


_KNOWN_SQL = "known(lemma, status) AS (VALUES " + ", ".join(
    f"('{w}', '{('known', 'learning', 'ignore', 'maybe')[i % 4]}')" for i, w in enumerate(_KNOWN)
) + ", ('the', 'learning'))"


@query("agg_1", f"WITH {oracle.FREQUENCY} SELECT * FROM freq")
def agg_1(spark, sf_dir):
    return stats.lemma_frequency(_tokens(spark, sf_dir))


@query(
    "flt_1",
    f"WITH {oracle.TOKENS} SELECT lemma, count(*) AS n FROM tok WHERE is_alpha GROUP BY lemma",
)
def flt_1(spark, sf_dir):
    kept = tokens.learnable(_words(spark, sf_dir), stop=True, proper=True)
    return kept.groupBy("lemma").agg(F.sum("n").alias("n"))


@query("fn_8", f"WITH {oracle.ZIPF} SELECT lemma, book_freq, round(global_zipf, 9) AS global_zipf FROM zipfed")
def fn_8(spark, sf_dir):
    return _stats(spark, sf_dir).select("lemma", "book_freq", F.round("global_zipf", 9).alias("global_zipf"))


@query("flt_2", f"WITH {oracle.ZIPF} SELECT lemma, book_freq FROM kept")
def flt_2(spark, sf_dir):
    return stats.by_frequency(_stats(spark, sf_dir)).select("lemma", "book_freq")


@query("rnk_1", f"WITH {oracle.ZIPF} SELECT lemma, book_freq, round(score, 9) AS score FROM scored")
def rnk_1(spark, sf_dir):
    return _ranked(spark, sf_dir).select("lemma", "book_freq", F.round("score", 9).alias("score"))


@query("flt_3", f"WITH {oracle.FREQUENCY}, {_KNOWN_SQL} SELECT freq.lemma, book_freq FROM freq LEFT JOIN known USING (lemma) WHERE coalesce(status, '') NOT IN ('known')")
def flt_3(spark, sf_dir):
    found = stats.word_frequency(_words(spark, sf_dir))
    return known.by_status(found, _known(spark), ("known",)).select("lemma", "book_freq")


@query("flt_4", f"WITH {oracle.FREQUENCY}, {_KNOWN_SQL} SELECT freq.lemma, book_freq FROM freq LEFT JOIN known USING (lemma) WHERE coalesce(status, '') NOT IN ('known', 'ignore')")
def flt_4(spark, sf_dir):
    return known.by_status(stats.word_frequency(_words(spark, sf_dir)), _known(spark)).select("lemma", "book_freq")


@query("flt_5", f"WITH {oracle.FREQUENCY} SELECT lemma, book_freq FROM freq WHERE lemma NOT IN ({oracle.listed(lexicon.DIALECT)})")
def flt_5(spark, sf_dir):
    return stats.without_dialect(stats.word_frequency(_words(spark, sf_dir))).select("lemma", "book_freq")


_PHRASE_STATS = PHRASES + ", ps AS (SELECT phrasal, count(*) AS book_freq, 'phrasal_verb' AS item_type FROM phr GROUP BY phrasal)"


@query("agg_2", f"WITH {_PHRASE_STATS} SELECT * FROM ps")
def agg_2(spark, sf_dir):
    return mwe.phrase_stats(phrases(spark, sf_dir))


@query("flt_6", f"WITH {_PHRASE_STATS} SELECT * FROM ps WHERE book_freq >= 2 AND phrasal NOT IN ('be in', 'be of')")
def flt_6(spark, sf_dir):
    words = spark.createDataFrame([("Be In", "learning"), ("be of", "known")], "lemma string, status string")
    return known.unknown_phrases(mwe.phrase_stats(phrases(spark, sf_dir)), words)


@query("rnk_2", f"WITH {_PHRASE_STATS} SELECT phrasal, book_freq, round(book_freq / CAST((SELECT max(book_freq) FROM ps) AS DOUBLE), 9) AS score FROM ps")
def rnk_2(spark, sf_dir):
    found = stats.ranked_phrases(mwe.phrase_stats(phrases(spark, sf_dir)))
    return found.select("phrasal", "book_freq", F.round("score", 9).alias("score"))


_MWE = _PHRASE_STATS + """, ids AS (SELECT phrasal, string_agg(CAST(sentence_id AS VARCHAR), ',' ORDER BY sentence_id) AS ids
  FROM (SELECT *, row_number() OVER (PARTITION BY phrasal ORDER BY sentence_id) AS n FROM phr) WHERE n <= 10 GROUP BY phrasal)"""


@query("agg_3", f"WITH {_MWE} SELECT phrasal AS headword, 'phrasal' AS type, book_freq AS count, coalesce(ids, '') AS ids, 'dictionary' AS source FROM ps LEFT JOIN ids USING (phrasal)")
def agg_3(spark, sf_dir):
    found = phrases(spark, sf_dir)
    rows = mwe.candidates(mwe.phrase_stats(found), found)
    return rows.withColumn("ids", F.array_join(F.transform("sample_sentence_ids", lambda i: i.cast("string")), ",")).drop("sample_sentence_ids")


@query("jn_2", f"WITH {_MWE} SELECT phrasal AS headword, CAST(len(string_split(ids, ',')) AS INTEGER) AS n FROM ps LEFT JOIN ids USING (phrasal)")
def jn_2(spark, sf_dir):
    found = phrases(spark, sf_dir)
    return mwe.candidates(mwe.phrase_stats(found), found).select("headword", F.size("sample_sentence_ids").alias("n"))


@query("rnk_8", f"WITH {_PHRASE_STATS} SELECT phrasal AS headword, book_freq AS count FROM ps ORDER BY book_freq DESC, phrasal LIMIT 5")
def rnk_8(spark, sf_dir):
    found = phrases(spark, sf_dir)
    return mwe.deck(mwe.candidates(mwe.phrase_stats(found), found), top_k=5).select("headword", "count")


TOP_K = """
, a AS (SELECT *, length(sentence) AS l, abs(length(sentence) - 100.0) AS d FROM pairs WHERE sentence <> ''),
b AS (SELECT *, l BETWEEN 50 AND 150 AS ina, l BETWEEN 20 AND 300 AS inb FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY item, ina ORDER BY d, ord) AS ra, row_number() OVER (PARTITION BY item, inb ORDER BY d, ord) AS rb,
  least(3, sum(CAST(ina AS INT)) OVER (PARTITION BY item)) AS na, sum(CAST(inb AS INT)) OVER (PARTITION BY item) AS tb FROM b),
d AS (SELECT *, ina AND ra <= 3 AS pa, inb AND rb <= 3 - na AS pb, least(3 - na, tb) AS nb FROM c),
e AS (SELECT *, max(CAST(pa OR pb AS INT)) OVER (PARTITION BY item, sentence) = 1 AS used FROM d),
f AS (SELECT *, NOT used AND row_number() OVER (PARTITION BY item, used ORDER BY d, ord) <= 3 - na - nb AS pc FROM e),
g AS (SELECT item, 1 AS p, d, ord, sentence FROM f WHERE pa UNION ALL SELECT item, 2, d, ord, sentence FROM f WHERE pb UNION ALL SELECT item, 3, d, ord, sentence FROM f WHERE pc),
h AS (SELECT *, row_number() OVER (PARTITION BY item, sentence ORDER BY p, d, ord) AS again FROM g)"""
TOP_K_ROWS = "SELECT item, string_agg(sentence, ' <br><br> ' ORDER BY p, d, ord) AS example FROM h WHERE again = 1 GROUP BY item"
_TOP_K = f"{TOP_K} {TOP_K_ROWS}"


@query("rnk_3", f"WITH {oracle.SENTENCES}, pairs AS (SELECT book AS item, sentence, sentence_id AS ord FROM sent) {_TOP_K}")
def rnk_3(spark, sf_dir):
    found = tokens.sentences(table(spark, sf_dir, "documents"))
    pairs = found.select(F.col("book").alias("item"), "sentence", F.col("sentence_id").alias("ord"))
    return examples.top_sentences(pairs, "item").select("item", F.array_join("examples", examples.JOINER).alias("example"))


@query(
    "rnk_4",
    f"""WITH {oracle.ZIPF}, best AS (SELECT lemma FROM scored ORDER BY score DESC, lemma LIMIT 100),
    pairs AS (SELECT DISTINCT t.lemma AS item, s.sentence, s.sentence_id AS ord FROM tok t JOIN best USING (lemma) JOIN sent s USING (sentence_id)) {_TOP_K}""",
)
def rnk_4(spark, sf_dir):
    own, found = tokens.RegexAnnotator(), tokens.sentences(table(spark, sf_dir, "documents"))
    words = own.counted(found)
    ranked = stats.ranked(stats.by_frequency(stats.word_frequency_with_zipf(words)))
    best = materialize(words.join(stats.top(ranked, 100).select("lemma"), "lemma", "left_semi"), "best-words")
    rows = examples.for_candidates(ranked, own.uses(found, best), found, top_n=100)
    return rows.where("example is not null").select(F.col("lemma").alias("item"), "example")


@query("rnk_5", f"WITH {PHRASES}, pairs AS (SELECT phrasal AS item, sentence, sentence_id AS ord FROM phr JOIN sent USING (sentence_id)) {_TOP_K}")
def rnk_5(spark, sf_dir):
    sentences = tokens.sentences(table(spark, sf_dir, "documents")).select("sentence_id", "sentence")
    pairs = phrases(spark, sf_dir).join(sentences, "sentence_id").select(F.col("phrasal").alias("item"), "sentence", F.col("sentence_id").alias("ord"))
    return examples.top_sentences(pairs, "item").select("item", F.array_join("examples", examples.JOINER).alias("example"))


@query(
    "rnk_6",
    f"""WITH {oracle.SENTENCES}, a AS (SELECT book AS item, sentence, sentence_id AS ord, length(sentence) AS l, abs(length(sentence) - 100.0) AS d FROM sent),
    b AS (SELECT *, CASE WHEN l BETWEEN 50 AND 150 THEN 0 WHEN l BETWEEN 20 AND 300 THEN 1 ELSE 2 END AS c FROM a),
    e AS (SELECT * FROM b QUALIFY c = min(c) OVER (PARTITION BY item)),
    f AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY CASE WHEN c = 1 THEN d ELSE l END, ord) AS r, count(*) OVER (PARTITION BY item) AS n FROM e)
    SELECT item, sentence FROM f WHERE r = CASE WHEN c = 1 THEN 1 ELSE n // 2 + 1 END""",
)
def rnk_6(spark, sf_dir):
    found = tokens.sentences(table(spark, sf_dir, "documents"))
    return examples.optimal_sentence(found.select(F.col("book").alias("item"), "sentence", F.col("sentence_id").alias("ord")), "item")


@query("rnk_7", f"WITH {oracle.ZIPF} SELECT lemma, round(score, 9) AS score FROM scored ORDER BY scored.score DESC, lemma LIMIT 100")
def rnk_7(spark, sf_dir):
    return stats.top(_ranked(spark, sf_dir), 100).select("lemma", F.round("score", 9).alias("score"))


@query(
    "jn_7",
    f"""WITH {oracle.SENTENCES}, m AS (SELECT h AS headword, sentence_id, sentence, row_number() OVER (PARTITION BY h ORDER BY sentence_id) AS n
      FROM sent, (SELECT unnest(['of the', 'in an', 'thand', 'was']) AS h)
      WHERE CASE WHEN contains(h, ' ') THEN contains(lower(regexp_replace(sentence, '[ \\t\\r\\f]+', ' ', 'g')), h) ELSE regexp_matches(sentence, '(?i)\\b' || h || '\\b') END)
    SELECT headword, sentence_id, sentence FROM m WHERE n <= 10""",
)
def jn_7(spark, sf_dir):
    heads = spark.createDataFrame([("of the",), ("in an",), ("thand",), ("was",)], "headword string")
    found = mwe.sentences_with(heads, tokens.sentences(table(spark, sf_dir, "documents")).select("sentence_id", "sentence"))
    return found.select("headword", "sentence_id", "sentence")


@query("flt_16", f"WITH {oracle.SENTENCES} SELECT 'orphan' AS problem, sentence_id FROM sent WHERE length(sentence) > 200")
def flt_16(spark, sf_dir):
    found = tokens.sentences(table(spark, sf_dir, "documents"))
    short = found.where(F.length("sentence") <= 200)
    return tokens.check_sentences(found.select("sentence_id"), short)


@query("flt_7", f"WITH {oracle.TOKENS} SELECT book, count(*) AS n FROM tok WHERE is_alpha AND NOT is_stop AND pos IN ('NOUN', 'VERB', 'ADJ', 'ADV') GROUP BY book")
def flt_7(spark, sf_dir):
    return tokens.content(_tokens(spark, sf_dir)).groupBy("book").agg(F.count(F.lit(1)).alias("n"))


@query("flt_8", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def flt_8(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 5000")
    orders = table(spark, sf_dir, "orders")
    return orders.join(rich, orders["o_custkey"] == rich["c_custkey"], "left_semi").select("o_orderkey", "o_totalprice")


@query("jn_1", f"WITH {oracle.FREQUENCY}, {_KNOWN_SQL} SELECT freq.lemma, status FROM freq LEFT JOIN known USING (lemma)")
def jn_1(spark, sf_dir):
    found = stats.word_frequency(_words(spark, sf_dir))
    return found.join(_known(spark).select("lemma", "status"), "lemma", "left").select("lemma", "status")


@query("jn_5", f"WITH {oracle.TOKENS} SELECT sentence, count(*) AS n FROM tok JOIN sent USING (sentence_id) GROUP BY sentence_id, sentence")
def jn_5(spark, sf_dir):
    found = tokens.sentences(table(spark, sf_dir, "documents"))
    counts = tokens.RegexAnnotator().tokens(found).groupBy("sentence_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(found, "sentence_id").select("sentence", "n")


@query("set_1", "SELECT p_name AS front, 'No example yet.' AS back, 'part' AS tags FROM part UNION ALL SELECT s_name, 'No example yet.', 'supplier' FROM supplier")
def set_1(spark, sf_dir):
    none = F.lit(None).cast("string")
    parts = examples.anki(table(spark, sf_dir, "part").withColumn("example", none), "p_name", "part")
    return parts.unionByName(examples.anki(table(spark, sf_dir, "supplier").withColumn("example", none), "s_name", "supplier"))


@query("set_2", f"WITH {PHRASES} SELECT DISTINCT book, sentence_id, phrasal FROM phr")
def set_2(spark, sf_dir):
    return phrases(spark, sf_dir).select("book", "sentence_id", "phrasal").dropDuplicates()


def _event_words(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(
        F.concat(F.lit("W"), (F.col("user_id") % 97).cast("string")).alias("lemma"),
        F.col("event_type").alias("status"),
        F.lit("word").alias("item_type"),
        F.col("props").alias("tags"),
        F.col("event_id").alias("ord"),
    )


_WORDS_SQL = "words AS (SELECT 'w' || (user_id % 97) AS lemma, event_type AS status, 'word' AS item_type, props AS tags, '' AS synset_id, event_id FROM events), last AS (SELECT * EXCLUDE (event_id) FROM words QUALIFY row_number() OVER (PARTITION BY lemma ORDER BY event_id DESC) = 1)"


@query("set_3", f"WITH {_WORDS_SQL} SELECT * FROM last")
def set_3(spark, sf_dir):
    return known.normalized(_event_words(spark, sf_dir), "ord")


@query(
    "set_4",
    f"WITH {_WORDS_SQL} SELECT * FROM last WHERE lemma NOT IN ('w1', 'w2') UNION ALL SELECT * FROM (VALUES ('w1', 'known', 'word', 'new', ''), ('zz', 'maybe', 'word', 'new', ''), ('w2', 'ignore', 'word', 'new', ''))",
)
def set_4(spark, sf_dir):
    rows = known.normalized(_event_words(spark, sf_dir), "ord")
    more = spark.createDataFrame([("w1", "known", "word", "new", ""), ("zz", "maybe", "word", "new", ""), ("w2", "ignore", "word", "new", "")], rows.schema)
    return known.upsert(rows, more)


@query("set_5", f"WITH {_WORDS_SQL} SELECT lemma, CASE WHEN lemma = 'w5' THEN 'known' ELSE status END AS status FROM last")
def set_5(spark, sf_dir):
    rows = known.normalized(_event_words(spark, sf_dir), "ord")
    learned = spark.createDataFrame([("w5", "known", "word", "", "")], rows.schema)
    return known.upsert(rows, learned).select("lemma", "status")


@query("agg_7", f"WITH {_WORDS_SQL} SELECT status, count(*) AS n FROM last GROUP BY status")
def agg_7(spark, sf_dir):
    return known.progress(known.normalized(_event_words(spark, sf_dir), "ord"))


@query(
    "plan_vocabulary",
    f"WITH {oracle.ZIPF}, {_KNOWN_SQL} SELECT scored.lemma, book_freq, round(score, 9) AS score FROM scored LEFT JOIN known USING (lemma) WHERE coalesce(status, '') NOT IN ('known', 'ignore') ORDER BY scored.score DESC, scored.lemma LIMIT 100",
)
def plan_vocabulary(spark, sf_dir):
    """Tokens to ranked candidates: scores are taken before known words go."""
    found = known.by_status(_ranked(spark, sf_dir), _known(spark))
    return stats.top(found, 100).select("lemma", "book_freq", F.round("score", 9).alias("score"))
