"""Batch runs, stores and drivers, against small tables with known outcomes."""

import json

import pytest
from pyspark.sql import functions as F

from glossmill import __main__ as command
from glossmill import drivers, records
from glossmill.operators import batch, families, mwe, stats, tokens
from glossmill.sources import stores, tables


def response(*cards):
    text = "```json\n" + json.dumps({"cards": list(cards)}) + "\n```"
    return json.dumps({"candidates": [{"content": {"parts": [{"text": text}]}}]})


def card(definition="a sense", indices=(1,), pos="noun"):
    return {"meaning_id": 1, "definition_en": definition, "definition_ru": "d", "part_of_speech": pos, "selected_example_indices": list(indices)}


EXAMPLES = [("run", ["I run home.", "They run far."]), ("give up", ["We give up now."]), ("cat", ["A dog barks.", "The cat sat."])]


def run(spark, path, rows, **more):
    results = spark.createDataFrame(rows, "key string, response string")
    examples = spark.createDataFrame(EXAMPLES, "lemma string, examples array<string>")
    return batch.parse_results(results, examples, f"file://{path}", **{"thresholds": {k: 1.0 for k in batch.GATE}, **more})


def kinds(log):
    return sorted((r["lemma"], r["error_type"]) for r in log.collect())


def test_every_strict_check_drops_its_cards(spark, tmp_path):
    rows = [
        ("lemma:run", response(card(), card("a quite other meaning", [2]), card("a sense"), card("no example", [9]), card("", [1]))),
        ("lemma:give up", response(card())),
        ("lemma:cat", response(card(indices=[1]))),
        ("other", response(card())),
        ("lemma:run", "{}"),
    ]
    cards, log = run(spark, tmp_path, rows)
    assert sorted((r["lemma"], r["definition_en"]) for r in cards.collect()) == [("run", "a quite other meaning"), ("run", "a sense")]
    assert {r["schema_version"] for r in cards.collect()} == {"1"}
    assert kinds(log) == [
        ("", "bad_key"),
        ("cat", "lemma_not_in_example"),
        ("give up", "headword_invalid_for_mode"),
        ("run", "duplicate_sense"),
        ("run", "no_candidates"),
        ("run", "validation"),
    ]
    phrasal, _ = run(spark, tmp_path / "p", rows, mode="phrasal")
    assert "give up" in {r["lemma"] for r in phrasal.collect()}
    pos = spark.createDataFrame([("run", ["VERB", "VERB"])], "lemma string, pos_list array<string>")
    left, wrong = run(spark, tmp_path / "q", rows, pos_lists=pos)
    assert left.count() == 0 and ("run", "pos_mismatch") in kinds(wrong)


def test_a_gate_that_fails_writes_no_cards(spark, tmp_path):
    with pytest.raises(batch.GateFailed, match="duplicate_sense"):
        run(spark, tmp_path, [("lemma:run", response(card(), card()))], thresholds={"duplicate_sense": 0.1})
    assert not (tmp_path / "cards").exists()


def test_a_card_that_breaks_its_contract_is_an_error(spark):
    bad = spark.createDataFrame([("k", "run", "", ["x"], "[1]")], "key string, lemma string, definition_en string, examples array<string>, selected_example_indices string")
    with pytest.raises(Exception, match="breaks its contract: k"):
        batch.under_contract(bad).select("lemma").collect()


def test_retries_come_from_the_cache_and_replace_cards_only_if_good(spark, tmp_path):
    results = spark.createDataFrame([("lemma:run", response(card(indices=[9]))), ("lemma:cat", response(card(indices=[9])))], "key string, response string")
    examples = spark.createDataFrame(EXAMPLES, "lemma string, examples array<string>")
    parsed = families.parse(results).where("error is null and card is not null")
    cards = families.with_examples(parsed, examples)
    asked = []

    def ask(requests):
        asked.append(sorted(r["key"] for r in requests.collect()))
        good = F.when(F.col("key") == "lemma:run", F.lit(response(card("better")))).otherwise(F.lit(response(card("worse", [7]))))
        return requests.select("key", good.alias("response"))

    cache = f"file://{tmp_path}/cache"
    for source in ("network", "cache"):
        merged, log = batch.retry(cards, examples, ask, cache)
        assert sorted(map(tuple, log.collect())) == [("cat", source, "validation_failed"), ("run", source, "success")]
        got = {r["lemma"]: (r["definition_en"], r["examples"]) for r in merged.collect()}
        assert got == {"run": ("better", ["I run home."]), "cat": ("a sense", [])}
    assert asked == [["lemma:cat", "lemma:run"], []]
    none, _ = batch.retry(cards, examples, ask, cache, batch.Policy(empty=False, fallback=False))
    assert {r["definition_en"] for r in none.collect()} == {"a sense"}


def test_blocks_count_on_where_the_one_before_ended(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"The word{i} ran.") for i in range(7)], "doc_id long, text string")
    blocks = families.example_blocks(tokens.tokenize(docs), tokens.sentences(docs), 3).where("lemma = 'run'")
    ask = lambda requests: requests.select("key", F.lit(response(card(indices=[1, 3, 4]))).alias("response"))
    got = batch.cluster(blocks, ask, f"file://{tmp_path}/c").collect()
    assert sorted((r["block"], r["indices"]) for r in got) == [(0, [1, 3]), (1, [4, 6]), (2, [7])]


def test_labels_are_asked_for_again_until_they_can_be_read(spark):
    items = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p")], "key long, prompt string")
    seen = []

    def ask(requests, n):
        seen.append({r["prompt"] for r in requests.collect()})
        return requests.where("key <> 3").select("key", F.when(F.col("key") <= n, F.lit("ok")).alias("response"))

    got = sorted(map(tuple, batch.labelled(items, ask, lambda r: F.when(r == "ok", r), 2).collect()), key=str)
    assert got == [(1, 1, "ok"), (2, 2, "ok"), (3, 2, None)]
    assert seen[0] == {"p"} and all("valid JSON only" in p for p in seen[1])
    assert batch.waits(4, 0.5) == [0.5, 1.0, 2.0] and batch.waits(1) == []


def test_jobs(spark, tmp_path):
    jobs = batch.LocalJobs(spark, f"file://{tmp_path}/j", lambda r: r.select("key", F.upper("prompt").alias("response")))
    jobs.create("a", spark.createDataFrame([("k", "x")], "key string, prompt string"))
    with pytest.raises(RuntimeError):
        jobs.results("a")
    assert batch.wait(jobs, "a") == "SUCCEEDED"
    assert [tuple(r) for r in jobs.results("a").collect()] == [("k", "X")]
    with pytest.raises(ValueError):
        jobs.create("a", jobs.results("a"))
    jobs.states["b"] = "STUCK"
    with pytest.raises(TimeoutError):
        batch.wait(jobs, "b", polls=2, first=0.001)


def test_stores(spark, tmp_path):
    sheet = stores.Sheets(spark, f"file://{tmp_path}/s").worksheet("w")
    assert not sheet.exists() and sheet.load().count() == 0
    words = spark.createDataFrame([("a", "known", "word", "", None), ("b", "known", "word", "", None)], "lemma string, status string, item_type string, tags string, synset_id string")
    sheet.save(words)
    sheet.save(sheet.load().where("lemma = 'b'"))
    assert [r["lemma"] for r in sheet.load().collect()] == ["b"]
    with pytest.raises(ValueError):
        tables.known_words(spark, "gsheets://only", stores.Sheets(spark, "x"))
    with pytest.raises(ValueError):
        tables.known_words(spark, "gsheets://id/ws")
    runs = stores.Runs(spark, f"file://{tmp_path}/r")
    assert runs.tags() == []
    runs.save("x", words)
    assert runs.tags() == ["x"] and runs.load("x").count() == 2


def test_json_lines_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/l"
    tables.write_json_lines(spark.range(5), path)
    with pytest.raises(Exception):
        tables.write_json_lines(spark.range(3).selectExpr("raise_error('no') as id"), path)
    assert tables.read_json_lines(spark, path, "id long").count() == 5
    tables.write_json_lines(tables.read_json_lines(spark, path, "id long").where("id > 2"), path)
    assert sorted(r["id"] for r in tables.read_json_lines(spark, path, "id long").collect()) == [3, 4]


def test_checksums_see_repeated_rows(spark):
    def sums(values):
        return tuple(tables.table_checksum(spark.createDataFrame([(v,) for v in values], "x int")).first())

    assert sums([1, 1]) != sums([2, 2]) and sums([1, 2, 2]) == sums([2, 1, 2])


def test_record_defaults(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"id": 1, "synset_id": "s", "confidence": 0.9}\n{"id": 2, "confidence": 0.5, "flags": ["metaphor"], "judge_count": 3}\n')
    got = sorted(tuple(r) for r in records.label_outputs(spark, f"file://{tmp_path}/r.json", "id long").withColumn("r", records.needs_referee()).collect())
    assert got[0] == (1, "s", 0.9, [], "", 0, 2, False)
    assert got[1][3:7] == (["metaphor"], "", 0, 3) and got[1][7]


def test_one_pass_counts_equal_two_passes(spark):
    docs = spark.createDataFrame([(1, "The cat ran. A cat sat with Bob."), (2, "Dogs ran 3 times.")], "doc_id long, text string")
    found = tokens.tokenize(docs)
    two = stats.with_zipf(stats.lemma_frequency(found), stats.corpus_zipf(found))
    one = stats.lemma_frequency_with_zipf(found).select(*two.columns)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_few_and_many_headwords_find_the_same(spark, monkeypatch):
    sents = spark.createDataFrame([(1, "Don't give up the ship."), (2, "It isn't so."), (3, "Nothing")], "sentence_id long, sentence string")
    heads = spark.createDataFrame([("give up",), ("not",), ("ship",), ("none",)], "headword string")
    few = sorted(map(tuple, mwe.sentences_with(heads, sents).collect()))
    monkeypatch.setattr(mwe, "_FEW", 0)
    assert few == sorted(map(tuple, mwe.sentences_with(heads, sents).collect()))
    assert sorted((h, i) for i, _, h in few) == [("give up", 1), ("not", 1), ("not", 2), ("ship", 1)]


def test_too_many_sentences_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(tokens, "SENTENCES_PER_BOOK", 2)
    docs = spark.createDataFrame([(1, "A b. C d. E f.")], "doc_id long, text string")
    with pytest.raises(Exception, match="too many sentences"):
        tokens.sentences(docs).collect()


def test_command_line(spark, tmp_path):
    docs = spark.createDataFrame([(i, "The boat sailed quietly. Boats sail.") for i in range(5)], "doc_id long, text string")
    docs.write.parquet(f"file://{tmp_path}/d")
    common = ["--documents", f"file://{tmp_path}/d", "--book", "b", "--out", f"file://{tmp_path}/out"]
    command.main(["vocabulary", *common, "--n", "3"])
    deck = spark.read.csv(drivers.Paths(f"file://{tmp_path}/out").deck("b"), header=True)
    assert deck.columns == ["front", "back", "tags"]
    command.main(["sample", *common, "--n", "4"])
    assert spark.read.json(drivers.Paths(f"file://{tmp_path}/out").sample_stats("b")).first()["sentences"] == 4
    assert drivers.evaluate_stored(spark, f"file://{tmp_path}/none") == (False, f"no cards at file://{tmp_path}/none", 0)
