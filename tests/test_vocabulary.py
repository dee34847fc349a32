"""Operators on small tables with known outcomes."""

import pytest
from pyspark.sql import functions as F

from glossmill.functions import scores, text
from glossmill.operators import examples, families, gold, known, mwe, qc, report, senses, stats, tokens
from glossmill.sources import books, tables

TOKENS = [
    ("go", 0, False, "VERB", True),
    ("go", 1, False, "VERB", True),
    ("run", 1, False, "VERB", True),
    ("the", 2, True, "DET", True),
    ("london", 3, False, "PROPN", True),
    ("42", 4, False, "NUM", False),
]


@pytest.fixture(scope="module")
def toks(spark):
    return spark.createDataFrame(TOKENS, "lemma string, sentence_id long, is_stop boolean, pos string, is_alpha boolean")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_lemma_frequency(toks):
    assert rows(stats.lemma_frequency(toks)) == [("go", 2, 2, 2, 0, 0), ("run", 1, 1, 1, 0, 0)]
    assert {r["lemma"] for r in stats.lemma_frequency(toks, stop=True, proper=True, other=True).collect()} == {"go", "run", "the", "london", "42"}
    empty = stats.lemma_frequency(toks.where("false"))
    assert empty.columns == ["lemma", "book_freq", "doc_count", "verb_count", "other_pos_count", "stopword_count"]
    assert empty.count() == 0
    with pytest.raises(ValueError, match="missing required columns"):
        stats.lemma_frequency(toks.drop("pos"))


def test_frequency_bounds_are_inclusive(spark):
    df = spark.createDataFrame([("rare", 2, "1.5"), ("low", 3, "2.0"), ("medium", 5, "3.0"), ("common", 20, "6.0"), ("odd", 9, "x"), ("none", 9, None)], "lemma string, book_freq long, global_zipf string")
    assert [r[0] for r in rows(stats.by_frequency(df))] == ["low", "medium"]
    assert len(rows(stats.by_frequency(df, None, None, None))) == 6


def test_ranking(spark):
    df = spark.createDataFrame([("freq_high", 50, 6.0), ("rarer_mid", 20, 4.0), ("rare_low", 5, 2.5)], "lemma string, book_freq long, global_zipf double")
    ranked = stats.top(stats.ranked(df), 3).collect()
    assert ranked[0]["lemma"] == "rarer_mid" and ranked[0]["score"] == pytest.approx(0.4)
    assert stats.ranked(df.where("false")).columns[-1] == "score"
    assert value(spark, scores.rarity(F.lit(None))) == 0.0


def test_known_words(spark):
    found = spark.createDataFrame([("run",), ("jump",), ("sleep",)], "lemma string")
    words = spark.createDataFrame([("run", "known"), ("run", "learning"), ("sleep", "IGNORE")], "lemma string, status string")
    assert rows(known.by_status(found, words)) == [("jump",), ("run",)]
    assert rows(known.by_status(found, words, ("learning",))) == [("jump",), ("run",), ("sleep",)]
    raw = spark.createDataFrame([("run", "known", "word", "a", 1), ("Run ", "learning", "word", None, 2), ("give up", "known", "phrasal_verb", "", 3)], "lemma string, status string, item_type string, tags string, n long")
    clean = known.normalized(raw, "n")
    assert rows(clean.select("lemma", "status", "tags")) == [("give up", "known", ""), ("run", "learning", "")]
    updated = known.upsert(clean, spark.createDataFrame([("run", "known", "word", "t", "")], clean.schema))
    assert ("run", "known", "word", "t", "") in rows(updated) and updated.count() == 2


def test_dialect(spark):
    df = spark.createDataFrame([(w,) for w in "run AI walk De jump dis".split()], "lemma string")
    assert rows(stats.without_dialect(df)) == [("jump",), ("run",), ("walk",)]
    with pytest.raises(ValueError):
        stats.without_dialect(df, "word")


def test_preprocess(spark):
    raw = "﻿Book  iv \r\n“Hi”—he said­.  \r\n\r\n\r\n\r\nIt’s «so»\r12\n"
    assert value(spark, text.preprocess(F.lit(raw))) == 'Book iv.\n"Hi" - he said.\n\nIt’s "so"\n12'


def test_quotes(spark):
    assert value(spark, text.quote_spacing(F.lit('" That oldest boy'))) == "That oldest boy"
    assert value(spark, text.quote_spacing(F.lit('" That boy "'))) == '"That boy"'


def test_matching(spark):
    assert value(spark, text.word_in_text(F.lit("not"), F.lit("I don’t know")))
    assert not value(spark, text.word_in_text(F.lit("now"), F.lit("I don’t know")))
    assert value(spark, text.target_in_text(F.lit("up to"), F.lit("a cup tool")))
    assert not value(spark, text.target_in_text(F.lit(""), F.lit("a")))
    assert value(spark, text.word_in_text(F.lit("a.b"), F.lit("see a.b now"))) and not value(spark, text.word_in_text(F.lit("a.b"), F.lit("acb")))


def test_sentences_and_tokens(spark):
    docs = spark.createDataFrame([(1, "He gave it up. The cat, 3 mats!\nEnd"), (2, ""), (3, None)], "doc_id long, text string")
    found = rows(tokens.sentences(docs).select("book", "sentence"))
    assert found == [("1", "End"), ("1", "He gave it up."), ("1", "The cat, 3 mats!")]
    made = tokens.tokenize(docs)
    assert {"cat", ",", "3"} <= {r["surface"] for r in made.collect()}
    back = {r["sentence"] for r in tokens.reconstruct(made).collect()}
    assert "The cat , 3 mats !" in back
    pairs = spark.createDataFrame([("give", "up")], "verb string, particle string")
    assert rows(mwe.phrasal_verbs_of_tokens(made, pairs, verbs_only=False).select("book", "phrasal")) == [("1", "give up")]
    assert rows(mwe.phrasal_verbs(tokens.sentences(docs), pairs).select("book", "phrasal")) == [("1", "give up")]


def test_running_offsets(spark):
    df = spark.createDataFrame([(i * 3, i % 5) for i in range(200)], "k long, n long")
    got = {r["k"]: r["offset"] for r in tokens.running_offsets(df, "k", "n", 16).collect()}
    total = 0
    for i in range(200):
        assert got[i * 3] == total
        total += i % 5


def plain_top(texts, k=3):
    """The choice of example sentences, step by step."""
    pool = [(t, abs(len(t) - 100)) for t in texts if t]

    def pick(lo, hi, n):
        return [t for t, _ in sorted([p for p in pool if lo <= len(p[0]) <= hi], key=lambda p: p[1])[: max(0, n)]]

    out = pick(50, 150, k)
    out += pick(20, 300, k - len(out))
    out += [t for t, _ in sorted([p for p in pool if p[0] not in out], key=lambda p: p[1])[: max(0, k - len(out))]]
    return list(dict.fromkeys(out))


def test_top_sentences(spark):
    import random

    rng = random.Random(3)
    groups = {g: [("abcd"[rng.randrange(4)] * rng.choice([5, 15, 25, 60, 90, 110, 160, 280, 310, 500])) for _ in range(rng.randrange(1, 9))] for g in range(60)}
    data = [(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)]
    got = {r["g"]: r["examples"] for r in examples.top_sentences(spark.createDataFrame(data, "g int, ord int, sentence string"), "g").collect()}
    assert got == {g: plain_top(ts) for g, ts in groups.items()}


def test_examples_for_candidates(spark):
    found = spark.createDataFrame([("light", 3.0), ("door", 2.0), ("unknown", 1.0)], "lemma string, score double")
    toks = spark.createDataFrame([("light", 0), ("light", 1), ("door", 2)], "lemma string, sentence_id long")
    sents = spark.createDataFrame([(0, "The light."), (1, "A light here."), (2, "The door.")], "sentence_id long, sentence string")
    got = {r["lemma"]: r["example"] for r in examples.for_candidates(found, toks, sents).collect()}
    assert got == {"light": "A light here. <br><br> The light.", "door": "The door.", "unknown": None}


def test_phrase_candidates(spark):
    rows_ = spark.createDataFrame([("give up", 1), ("give up", 2), ("look up", 1)], "phrasal string, sentence_id long")
    made = mwe.candidates(mwe.phrase_stats(rows_), rows_, most=1)
    assert {(r["headword"], r["count"], tuple(r["sample_sentence_ids"])) for r in made.collect()} == {("give up", 2, (1,)), ("look up", 1, (1,))}
    assert [r["headword"] for r in mwe.deck(made, top_k=1).collect()] == ["give up"]
    heads = spark.createDataFrame([("look up",), ("don't",), ("do",)], "headword string")
    sents = spark.createDataFrame([(1, "They look  up now."), (2, "I don’t."), (3, "lookup")], "sentence_id long, sentence string")
    assert rows(mwe.sentences_with(heads, sents).select("headword", "sentence_id")) == sorted([("do", 2), ("don't", 2), ("look up", 1)], key=str)


def test_no_nested_loop_for_phrases(spark):
    heads = spark.createDataFrame([("look up",)], "headword string")
    sents = spark.range(10).selectExpr("id as sentence_id", "'look up' as sentence")
    plan = mwe.sentences_with(heads, sents)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_groups_and_requests(spark):
    toks = spark.createDataFrame([("run", 1, 1, "VERB"), ("run", 2, 1, "VERB"), ("go", 3, 0, "VERB"), ("go", 4, 0, "NOUN")], "lemma string, sentence_id long, position int, pos string")
    toks = toks.withColumns({"is_alpha": F.lit(True), "is_stop": F.lit(False)})
    sents = spark.createDataFrame([(1, "He runs."), (2, "She runs."), (3, "Go away."), (4, "We go home.")], "sentence_id long, sentence string")
    made = families.groups(toks, sents, 1)
    assert {(r["lemma"], r["example_count"], len(r["examples"])) for r in made.collect()} == {("run", 2, 1), ("go", 2, 1)}
    keys = [r["key"] for r in families.requests(families.groups(toks, sents), "m", 5, 1).collect()]
    assert keys == ["lemma:go"]


def test_parse_results(spark):
    good = '{"candidates":[{"content":{"parts":[{"text":"```json\\n{\\"cards\\":[{\\"meaning_id\\":1,\\"definition_en\\":\\"d\\",\\"definition_ru\\":\\"r\\",\\"part_of_speech\\":\\"verb\\",\\"selected_example_indices\\":[1,9,\\"2\\",true]}]}\\n```"}]}}]}'
    data = [("lemma:run", good), ("other", good), ("lemma:a", "{}"), ("lemma:b", '{"candidates":[{"content":{"parts":[{"text":" "}]}}]}'), ("lemma:c", '{"candidates":[{"content":{"parts":[{"text":"{x"}]}}]}')]
    parsed = families.parse(spark.createDataFrame(data, "key string, response string"))
    assert rows(parsed.select("lemma", "error")) == sorted([("run", None), ("", "bad_key"), ("a", "no_candidates"), ("b", "empty_content"), ("c", "json_error")], key=str)
    words = spark.createDataFrame([("run", ["one", "two"])], "lemma string, examples array<string>")
    card = families.with_examples(parsed.where("error is null"), words).first()
    assert card["examples"] == ["one", "one"] and not card["examples_fallback"]
    kept, bad = families.valid(families.with_examples(parsed.where("error is null"), words).withColumn("definition_ru", F.lit(" ")))
    assert kept.count() == 0 and bad.first()["message"] == "missing or empty 'definition_ru'"


def test_quality_of_cards(spark):
    cards = spark.createDataFrame([("w", 1, "A thing of use"), ("w", 2, "a  thing of use "), ("w", 3, "something else"), ("v", 1, "A thing of use")], "lemma string, ord int, definition_en string")
    assert rows(qc.duplicate_senses(cards)) == [("w", 2, "a  thing of use ")]
    assert qc.similarity("", None) == 1.0 and qc.similarity("a", "") == 0.0
    assert value(spark, qc.lemma_missing(F.lit("hope"), F.array(F.lit("he hopped"))))
    assert not value(spark, qc.lemma_missing(F.lit("hop"), F.array(F.lit("he hopped"))))
    errors = spark.createDataFrame([("bad",), ("bad",), ("other",)], "error_type string")
    got = {r["error_type"]: (r["n"], r["failed"]) for r in qc.error_rates(errors, 7, {"bad": 0.2}).collect()}
    assert got == {"bad": (2, False), "other": (1, True)}


def test_sense_statistics(spark):
    data = [("word", "communication", 1), ("word", "communication", 2), ("word", "cognition", 3), ("test", "act", 4), ("test", "act", 5)]
    got = {(r["lemma"], r["supersense"]): r for r in senses.sense_statistics(spark.createDataFrame(data, "lemma string, supersense string, sentence_id long")).collect()}
    assert len(got) == 3
    r = got["word", "cognition"]
    assert (r["sense_count"], r["book_freq"], r["dominant_supersense"]) == (2, 3, "communication")


def test_votes(spark):
    none = []
    data = [(1, 1, "a", 0.9, none), (1, 2, "a", 0.7, none), (1, 3, "b", 1.0, none), (2, 1, "a", 0.5, none), (2, 2, "b", 0.8, ["x"]), (3, 1, "c", 0.9, none)]
    got = {r["example_id"]: r for r in gold.vote(spark.createDataFrame(data, "example_id int, judge int, synset_id string, confidence double, flags array<string>")).collect()}
    assert got[1]["synset_id"] == "a" and got[1]["confidence"] == pytest.approx(0.8) and not got[1]["needs_referee"]
    assert got[2]["synset_id"] == "b" and got[2]["needs_referee"] and got[2]["flags"] == ["x"]
    assert got[3]["needs_referee"] and got[3]["agreement_ratio"] == 1.0


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 9, 0.05 if i % 4 == 0 else 0.4, f"s{i % 6}") for i in range(300)], "k int, sense_count int, baseline_margin double, source string")
    one = gold.stratified(df, "k", 50)
    assert one.count() == 50 and rows(one) == rows(gold.stratified(df.repartition(7), "k", 50))
    assert gold.stratified(df, "k", 500).count() == 300
    split = gold.split_by_source(df, "source").select("source", "split").distinct()
    assert split.count() == 6 and split.where("split = 'dev'").count() == 1


def test_compare(spark):
    a = spark.createDataFrame([("x", 1, [1, 2]), ("y", 2, [1]), ("z", 3, None)], "k string, v int, l array<int>")
    b = spark.createDataFrame([("x", 1, [2, 1]), ("y", 9, [1]), ("w", 3, None)], a.schema)
    assert rows(report.compare(a, b, ["k"], ["v", "l"])) == [("w", "extra", ""), ("x", "equal", ""), ("y", "different", "v"), ("z", "missing", "")]


def test_books(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Chapter 1\r\n“Hi”", encoding="utf-8")
    assert books.read_book(spark, str(tmp_path / "a.txt")).first()["text"] == 'Chapter 1.\n"Hi"'
    pages = [("1.xhtml", "<html><head><title>t</title></head><body><p>One <b>two</b></p></body></html>"), ("2.xhtml", "<p> </p>"), ("3.xhtml", "<p>Three</p>")]
    (tmp_path / "b.epub").write_bytes(books.pack_epub(pages))
    assert books.read_book(spark, str(tmp_path / "b.epub")).first()["text"] == "One two\n\nThree"
    with pytest.raises(ValueError, match="unsupported"):
        books.read_book(spark, "c.pdf")
    assert all(len(c) <= 50 for c in books.chunks("Word here. " * 40, 50))


def test_tables(spark, tmp_path):
    store = tables.known_words(spark, str(tmp_path / "words"))
    assert not store.exists() and store.load().count() == 0
    store.save(spark.createDataFrame([("run", "known", "word", "t", "s")], "lemma string, status string, item_type string, tags string, synset_id string"))
    assert store.load().first()["lemma"] == "run"
    lines = spark.createDataFrame([('{"a":["x","y"]}',), ('{"b":[{"sentence_id":7,"text":"z"}]}',)], "value string")
    assert rows(tables.lemma_examples(lines)) == [("a", 0, None, "x"), ("a", 1, None, "y"), ("b", 0, 7, "z")]
    tables.write_json(str(tmp_path / "m" / "x.json"), {"a": 1})
    assert (tmp_path / "m" / "x.json").read_text().replace(" ", "") == '{\n"a":1\n}'
    df = spark.range(50)
    assert rows(tables.table_checksum(df)) == rows(tables.table_checksum(df.repartition(5)))


def test_streaming_counts(spark, tmp_path):
    from glossmill.streaming.counts import running_frequency

    spark.createDataFrame([(1, "cats run. cats sit.")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    q = running_frequency(stream).writeStream.outputMode("complete").format("memory").queryName("freq").start()
    q.processAllAvailable()
    q.stop()
    assert ("cat", 2) in rows(spark.table("freq"))


def test_character_spans(spark):
    data = [("The cat, the dog.", "cat", 1), ("The cat, the dog.", "the", 0), ("a the the", "the", 5), ("a b", "zz", 0), ("scan can can", "can", 0), ("", "x", 0)]
    df = spark.createDataFrame(data, "s string, w string, p int")
    got = [tuple(r["x"]) for r in df.select(gold.char_span(F.col("s"), F.col("w"), F.col("p")).alias("x")).collect()]
    assert got == [(4, 7), (9, 12), (2, 5), (0, 2), (1, 4), (0, 1)]


def test_parsed_labels(spark):
    def parsed(raw):
        return value(spark, gold.parse_label(F.lit(raw), F.array(F.lit("a"))))

    assert tuple(parsed('```json\n{"chosen_synset_id":"a","confidence":0.5,"flags":["odd","metaphor"]}\n```')) == ("a", 0.5, ["metaphor"])
    assert parsed('{"chosen_synset_id":"b","confidence":0.5}') is None
    assert parsed('{"chosen_synset_id":"b","flags":["none_of_the_above"]}') is not None
    assert parsed('{"chosen_synset_id":"a","confidence":1.5}') is None and parsed("no") is None
