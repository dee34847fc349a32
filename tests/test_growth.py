"""Queries whose cost grew faster than their input, or that held too much at once."""

import re

import pytest
from pyspark.sql import functions as F

from glossmill.functions.text import LETTERS
from glossmill.operators import batch, examples, families, gold, stats, tokens
from glossmill.plans import registry
from glossmill.sources import books
from test_entry import SF, same


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["agg_5", "agg_8", "rnk_9", "fn_18", "bat_6"])
def test_families_match_sql(spark, name):
    same(spark, name)


def test_lemmas_are_counted_without_the_texts_of_sentences(spark):
    assert plan(registry.QUERIES["agg_8"](spark, SF)).count("Join") == 1  # irregular forms


def test_groups_read_tokens_once(spark):
    text = plan(registry.QUERIES["fn_18"](spark, SF))
    assert text.count("Join") == 2  # irregular forms, and texts of the sentences that are left


def test_blocks_of_made_tokens_join_sentences_once(spark):
    docs = spark.createDataFrame([(1, "The cat runs. A cat ran. Cats run fast.")], "doc_id int, text string")
    sents, toks = tokens.sentences(docs), tokens.tokenize(docs)
    made, checked = (families.example_blocks(toks, sents, 2, made=m) for m in (True, False))
    assert plan(made).count("Join") < plan(checked).count("Join")
    assert sorted(made.collect()) == sorted(checked.collect())


def test_requests_that_repeat_are_asked_once_and_keep_their_columns(spark, tmp_path):
    rows = spark.createDataFrame([("a", "p", 1), ("a", "p", 2), ("b", "q", 3)], "key string, prompt string, n int")
    asked = []

    def ask(requests):
        asked.extend(sorted(r["key"] for r in requests.collect()))
        return requests.selectExpr("key", "upper(prompt) as response")

    got = batch.cached(rows, ask, f"file://{tmp_path}/cache", keep=("n",))
    assert asked == ["a", "b"]
    assert sorted((r["n"], r["response"]) for r in got.collect()) == [(1, "P"), (2, "P"), (3, "Q")]


@pytest.mark.parametrize("name", ["src_3", "src_4"])
def test_packed_books_match_sql_from_few_files(spark, name):
    same(spark, name)
    assert len(registry.QUERIES[name](spark, SF).inputFiles()) <= 8


def test_packed_books_of_other_kinds_or_without_text_are_errors(spark, tmp_path):
    for name, content in (("a.pdf", b"x"), ("b.txt", b"")):
        path = f"file://{tmp_path}/{name}"
        books.pack_books(spark.createDataFrame([(name, bytearray(content))], "path string, content binary"), path)
        with pytest.raises(Exception, match=name):
            books.read_packed(spark, path).collect()


def test_guidance_sends_no_table_of_items_to_all_tasks(spark):
    same(spark, "rnk_15")
    text = registry.QUERIES["rnk_15"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" not in text and "BuildLeft" not in text


@pytest.mark.parametrize("name", ["flt_1", "flt_2", "flt_4", "flt_5", "fn_8", "jn_1", "rnk_1", "rnk_4", "rnk_7", "txt_4_index"])
def test_words_that_are_counted_first_match_sql(spark, name):
    same(spark, name)


def test_words_are_classified_once_and_not_at_every_use(spark):
    text = plan(registry.QUERIES["flt_5"](spark, SF))
    assert "regexp_extract_all" not in text and "Relation [surface" in text  # reads counts of words, no texts
    docs = spark.createDataFrame([(1, "Runs ran. He runs o'er it's Édith runs. 3 RUNS - Run")], "doc_id int, text string")
    toks, words = tokens.tokenize(docs), tokens.RegexAnnotator().counted(tokens.sentences(docs))
    columns = ["surface", "lemma", "pos", "is_stop", "is_alpha"]
    want = toks.groupBy(*columns, (toks["position"] > 0).alias("inner")).count()
    assert sorted(words.selectExpr(*columns, "position > 0", "n").collect()) == sorted(want.select(*columns, "inner", "count").collect())


@pytest.mark.parametrize("name", ["src_1", "src_15"])
def test_pages_are_read_whole_from_few_files(spark, name):
    same(spark, name)
    assert len(registry.QUERIES[name](spark, SF).inputFiles()) <= 8


def test_texts_are_made_ready_once_for_all_words(spark):
    same(spark, "fn_3")
    text = plan(registry.QUERIES["fn_3"](spark, SF))
    assert text.index("RLIKE") < text.index("Generate explode") < text.index("regexp_replace")


def test_tokens_meet_their_senses_before_sentences(spark):
    same(spark, "bat_8")
    joins = re.findall(r"Join \w+, \(+(\w+)#", plan(registry.QUERIES["bat_8"](spark, SF)))
    assert joins[0] == "sentence_id" and "lemma" in joins[1:]  # the last join, above that with senses


def test_cards_of_few_lemmas_are_not_dealt_out_by_lemma(spark):
    same(spark, "flt_13")
    text = registry.QUERIES["flt_13"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in text and "Exchange hashpartitioning" not in text


def test_spans_that_miss_their_word_are_those_of_char_span(spark):
    texts = ["a cat sat", "cat, the cat", "scan can", "x\\Ey x\\Ey", "", None, "a  b\n c", "aa aaa"]
    words = ["cat", "can", "x\\Ey", "x", "", None, "aa", "b", "\\E", "a cat"]
    rows = spark.createDataFrame([(t, w, p) for t in texts for w in words for p in range(4)], "sentence string, surface string, position int")
    spanned = rows.withColumn("span", gold.char_span(rows["sentence"], rows["surface"], rows["position"]))
    want = spanned.where("NOT (substring(sentence, span.start + 1, span.stop - span.start) <=> surface)")
    got = gold.span_mismatches(rows)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0


def test_words_are_held_against_their_sentence_without_a_join(spark):
    same(spark, "txt_13")
    text = plan(registry.QUERIES["txt_13"](spark, SF))
    assert text.count("Join") == 1  # irregular forms
    assert text.count("regexp_extract_all") == 2  # sentences, and words once


def test_names_are_not_counted_and_no_filter_asks_for_tags(spark):
    same(spark, "agg_1")
    filters = [line for line in plan(registry.QUERIES["agg_1"](spark, SF)).splitlines() if re.match(r"\W*Filter ", line)]
    assert filters and not any("CASE WHEN" in line for line in filters)
    docs = spark.createDataFrame([(1, "He met Paris. Cats met cats."), (2, "A cat. The Paris")], "doc_id int, text string")
    toks = tokens.tokenize(docs)
    for proper in (False, True):
        want = tokens.learnable(toks, proper=proper).groupBy("lemma").agg(F.count("*"), F.count_distinct("sentence_id"))
        got = stats.lemma_frequency(toks, proper=proper)
        assert sorted(got.select("lemma", "book_freq", "doc_count").collect()) == sorted(want.collect())


@pytest.mark.parametrize("name", ["txt_7", "txt_11"])
def test_sentences_are_put_together_from_whole_lists(spark, name):
    same(spark, name)
    text = plan(registry.QUERIES[name](spark, SF))
    assert "posexplode(regexp_extract_all" not in text and "posexplode(read" not in text  # no row a token


def test_nested_tokens_are_those_of_the_table_even_if_ids_repeat(spark):
    docs = spark.createDataFrame([(1, "He went. \f\nIt's 3-4!"), (2, ""), (3, None), (1, "A b c d e. Fg"), (None, "Xy z")], "doc_id int, text string")
    sents = tokens.sentences(docs)
    for annotator in (tokens.RegexAnnotator(), tokens.LoadedAnnotator(tokens.plain_loader)):
        want = tokens.reconstruct(annotator.tokens(sents))
        got = tokens.reconstruct(annotator.nested(sents))
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_lists_of_equal_keys_are_merged_whatever_their_words_hold(spark):
    rows = [(1, ["a b", "c"]), (2, [""]), (3, ["x", "z"]), (3, ["y", "a b", "q"]), (4, ["a", "", "b"]), (None, ["m"]), (None, ["n", "o"])]
    nested = spark.createDataFrame(rows, "sentence_id int, surfaces array<string>")
    got = sorted(map(str, (list(r) for r in tokens.merged_lists(nested, ("sentence_id",)).collect())))
    want = [[1, ["a b", "c"]], [2, [""]], [3, ["x", "y", "a b", "z", "q"]], [4, ["a", "", "b"]], [None, ["m", "n", "o"]]]
    assert got == sorted(map(str, want))


def test_phrases_are_found_once_and_meet_the_chosen_sentences_only(spark):
    same(spark, "jn_3")
    text = plan(registry.QUERIES["jn_3"](spark, SF))
    assert text.count("regexp_extract_all") == 1  # sentences of the examples; phrases are read back
    assert "rightHint=(strategy=broadcast)" in text


def test_examples_chosen_by_length_are_those_chosen_by_text(spark):
    sizes = [5, 30, 60, 100, 100, 101, 99, 140, 200, 290, 400, 0, 51]
    sents = spark.createDataFrame([(i, chr(97 + i % 3) * n) for i, n in enumerate(sizes)], "sentence_id int, sentence string")
    found = spark.createDataFrame([(p, i) for p, ids in {"a": range(13), "b": [0, 1, 8, 10], "c": [11], "d": [3, 6, 3]}.items() for i in ids], "phrasal string, sentence_id int")
    counts = found.groupBy("phrasal").count()
    measured = found.join(sents.select("sentence_id", F.length("sentence").alias("length")), "sentence_id")
    want = examples.for_phrases(counts, found, sents)
    got = examples.for_phrases(counts, measured, sents)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())


def test_words_are_matched_by_table_as_by_ranges(spark):
    ranges = f"[{LETTERS}]+(?:'[a-z]+)?|[0-9]+|[^ \\t\\n\\r\\f\\x0B0-9{LETTERS}]"
    assert "A-Z" not in tokens.TOKEN and "0-9" not in tokens.TOKEN
    texts = ["".join(chr(c) + "a'b7 "[c % 5] for c in range(k, min(k + 500, 0xD800))) for k in range(0, 0xD800, 500)] + ["é's 12ab O'Neil's 𝒳x Ünïcødé ×÷ ɏɐ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select(*(F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (tokens.TOKEN, ranges))).collect():
        assert row[0] == row[1]
    assert all(re.findall(tokens.TOKEN, t) == re.findall(ranges, t) for t in texts)


def test_content_words_are_tagged_once_and_blocks_do_not_list_all_of_their_lemma(spark):
    text = plan(registry.QUERIES["agg_5"](spark, SF))
    assert not [line for line in text.splitlines() if re.match(r"\W*Filter ", line) and "CASE WHEN" in line]
    assert not [line for line in text.splitlines() if re.match(r"\W*Window ", line) and "collect" in line]
    docs = spark.createDataFrame([(1, "The cats ran. He met Paris in 1900; it's a good cat's life"), (2, None)], "doc_id int, text string")
    toks = tokens.tokenize(docs)
    want = toks.where("is_alpha AND NOT is_stop AND pos IN ('NOUN', 'VERB', 'ADJ', 'ADV')")
    got = tokens.content(toks)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect()) and got.count() > 0
    nulls = spark.createDataFrame([(None, False, "NOUN"), (True, None, "NOUN"), (True, False, None), (True, False, "NOUN")], "is_alpha boolean, is_stop boolean, pos string")
    assert tokens.content(nulls).count() == 1


def test_blocks_in_parts_are_those_of_all_at_once_and_leave_no_prompts(spark, tmp_path, monkeypatch):
    texts = ["The cats ran. A cat runs, cat! Paris met Paris\nCats run. Run", "Run cats run. It's a good dog's life; dogs ran", "", None, "A cat."]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    sents = tokens.sentences(docs)
    want = families.example_blocks(tokens.tokenize(docs), sents, 2, made=True)
    columns = ["lemma", "block", "offset", "examples"]
    monkeypatch.setattr(families, "PART_BYTES", 100)
    parts = families.block_parts(sents, 2)
    rows = [[tuple(map(str, r)) for r in p.select(*columns).collect()] for p in parts]
    assert len(parts) > 2 and len([p for p in rows if p]) > 1
    assert sorted(sum(rows, [])) == sorted(tuple(map(str, r)) for r in want.select(*columns).collect())

    seen = {}

    def ask(requests):
        seen.update({r["key"]: r["prompt"] for r in requests.collect()})
        text = '{"cards":[{"meaning_id":1,"definition_en":"x","selected_example_indices":[1,2,3]}]}'
        answer = F.to_json(F.expr(f"named_struct('candidates', array(named_struct('content', named_struct('parts', array(named_struct('text', '{text}'))))))"))
        return requests.select("key", answer.alias("response"))

    monkeypatch.setattr(spark.conf, "get", lambda name, *a, get=spark.conf.get: f"file://{tmp_path}/shared" if name == "spark.checkpoint.dir" else get(name, *a))
    whole = sorted(map(str, batch.cluster(want, ask, f"file://{tmp_path}/a").select("lemma", "block", "indices").collect()))
    prompts, _ = dict(seen), seen.clear()
    drafts = set(tmp_path.glob("shared/glossmill/*"))
    for source in ("network", "cache"):
        got = batch.cluster(parts, ask, f"file://{tmp_path}/b").select("lemma", "block", "indices")
        assert sorted(map(str, got.collect())) == whole and len(whole) > 5
        assert seen == (prompts if source == "network" else {})
        seen.clear()
    left = [p.name for p in set(tmp_path.glob("shared/glossmill/*")) - drafts]
    assert left and all(name.startswith("answered-") for name in left)


def test_uses_without_repeated_words_are_those_of_all_tokens(spark):
    texts = ["Paris met Paris. Cat cats cat Cats", "He ran. Runs run, ran RAN! 3 la la La", "Light light lights lit. Lit fire fires fired", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    want = families.uses(tokens.tokenize(docs))
    got = families.placed_uses(families.made_uses(tokens.sentences(docs)), 1)
    assert sorted(got.select("lemma", "sentence_id", "pos").collect()) == sorted(want.collect())
    assert got.select("lemma", "block").distinct().count() == got.count() > 8
    assert "Aggregate" not in plan(got)
