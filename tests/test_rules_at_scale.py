"""Greedy choices, journals, caches and books against plain versions that go row by row."""

import collections
import hashlib
import io
import itertools
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from glossmill.operators import batch, examples, gold, qc
from glossmill.sources import books
from glossmill.sources.shared import shared_path


def definitions(n, seed):
    """Definitions that repeat others, whole or with some letters changed, so that likeness chains."""
    rng = random.Random(seed)
    made = ["", " ", "A  Thing", "a thing"]
    while len(made) < n:
        if rng.random() < 0.5:
            text = list(rng.choice(made))
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text) + 1), rng.choice("abcde \t"))
            made.append("".join(text))
        else:
            made.append("".join(rng.choice("abcdefgh  ") for _ in range(rng.randrange(1, 60))))
    rng.shuffle(made)
    return made


def keep_first(rows, threshold):
    """(lemma, ord, definition) dropped by going through a lemma's cards in order."""
    dropped = []
    for lemma in sorted({r[0] for r in rows if r[0]}):
        kept = []
        for row in sorted((r for r in rows if r[0] == lemma), key=lambda r: (r[1], r[2] is not None, r[2] or "")):
            if any(qc.similarity(row[2], k) >= threshold for k in kept):
                dropped.append(row)
            else:
                kept.append(row[2])
    return sorted(dropped, key=str)


@pytest.mark.parametrize(("threshold", "block"), [(0.85, 1000), (0.7, 7), (1.0, 5)])
def test_duplicate_senses_are_those_of_the_greedy(spark, threshold, block):
    rng = random.Random(block)
    rows = [(rng.choice(["w", "w", "w", "v", "", None]), i // 2, t) for i, t in enumerate(definitions(130, block))]
    rows += [("w", 3, None), ("w", 900, None), ("w", 5, "a thing"), ("w", 5, "a thing")]
    cards = spark.createDataFrame(rows, "lemma string, ord int, definition_en string")
    got = sorted((tuple(r) for r in qc.duplicate_senses(cards, threshold, block).collect()), key=str)
    assert got == keep_first(rows, threshold)


def test_a_lemma_of_many_cards_is_dealt_over_tasks(spark):
    texts = definitions(400, 9)
    cards = spark.createDataFrame([("w", i, t) for i, t in enumerate(texts)], "lemma string, ord int, definition_en string")
    plain = F.pandas_udf(lambda s: s.map(qc.plain_definition), "string")
    rows = cards.select("lemma", F.col("ord").alias("__ord"), F.lit(1).alias("__k"), plain("definition_en").alias("__plain"))
    firsts = rows.groupBy("lemma", "__plain").agg(F.min("__ord").alias("__ord"), F.first("__k").alias("__k"))
    edges = qc._like_edges(firsts, 0.85, 20)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas [lemma" in plan and "__low" in plan
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(qc.plain_definition(t), i)
    want = {
        (min(i, j), max(i, j))
        for (a, i), (b, j) in itertools.combinations(least.items(), 2)
        if a and b and qc._ratio(b if j > i else a, a if j > i else b) >= 0.85
    }
    assert {(r["a"]["__ord"], r["b"]["__ord"]) for r in edges.collect()} == want


def test_duplicate_senses_of_nothing(spark):
    none = spark.createDataFrame([], "lemma string, ord int, definition_en string, a array<int>")
    assert qc.duplicate_senses(none).count() == 0 and qc.duplicate_senses(none).columns == none.columns


def plain_split(counts, ratio, seed=42):
    order = sorted(counts, key=lambda s: hashlib.md5((f"{s}|{seed}" if s is not None else str(seed)).encode()).hexdigest())
    room, dev = int(sum(counts.values()) * ratio), set()
    for s in order:
        if counts[s] <= room:
            dev.add(s)
            room -= counts[s]
    return dev


@pytest.mark.parametrize("ratio", [0.0, 0.25, 0.6, 1.0])
def test_split_by_source_is_the_greedy(spark, ratio):
    rng = random.Random(1)
    counts = {None: 3, "": 2, **{f"s{i}": rng.choice([1, 1, 2, 3, 5, 40, 90]) for i in range(60)}}
    rows = [(s, i) for s, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "source string, i int").repartition(5)
    got = gold.split_by_source(df, "source", ratio).collect()
    assert len(got) == len(rows)
    dev = plain_split(counts, ratio)
    assert all((r["split"] == "dev") == (r["source"] in dev) for r in got)
    assert gold.split_by_source(df.where("false"), "source").count() == 0


def test_many_sources_are_split_by_a_join(spark):
    df = spark.range(20_000).select((F.col("id") % 7000).alias("source"), "id")
    split = gold.split_by_source(df, "source")
    counts = collections.Counter(i % 7000 for i in range(20_000))
    dev = plain_split(counts, 0.25)
    assert {r["source"] for r in split.where("split = 'dev'").select("source").distinct().collect()} == dev
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "InSet" not in plan and " IN " not in plan


def plain_examples(pairs, k, low=50, high=150, wide_low=20, wide_high=300):
    """The rule as told: preferred lengths, then the wider range with those again, then the rest."""
    rows = sorted((abs(len(s) - (low + high) / 2), o, s) for o, s in pairs if s)
    a = [r for r in rows if low <= len(r[2]) <= high][:k]
    b = [r for r in rows if wide_low <= len(r[2]) <= wide_high][: k - len(a)]
    used = {r[2] for r in a + b}
    c = [r for r in rows if r[2] not in used][: k - len(a) - len(b)]
    return list(dict.fromkeys(r[2] for r in a + b + c))


def test_top_sentences_cut_before_the_shuffle(spark):
    rng = random.Random(5)
    items = {}
    for item in "abcdefghij":
        lengths = [rng.choice([5, 10, 30, 60, 100, 140, 200, 310, 400]) for _ in range(rng.randrange(1, 9))]
        items[item] = [(i, "x" * n if rng.random() < 0.8 else "y" * n) for i, n in enumerate(lengths)]
    rows = [(item, o, s) for item, pairs in items.items() for o, s in pairs] + [("a", 99, ""), ("z", 1, None)]
    df = spark.createDataFrame(rows, "item string, ord int, sentence string").repartition(4)
    for k in (1, 3, 5):
        got = {r["item"]: r["examples"] for r in examples.top_sentences(df, "item", k).collect()}
        assert got == {item: plain_examples(pairs, k) for item, pairs in items.items()}
    plan = examples.top_sentences(df, "item")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan and plan.count("Window [") == 1


class Counting:
    """A model that counts what it is asked, in files, since plans may run more than once."""

    def __init__(self, path, good):
        self.path, self.good = path, good

    def __call__(self, requests, n=1):
        path, good = self.path, self.good

        def run(frames):
            for frame in frames:
                for key in frame["key"]:
                    with open(os.path.join(path, f"{n}-{key}"), "a", encoding="utf-8") as out:
                        out.write("x")
                yield frame.assign(response=[good(int(k), n) for k in frame["key"]])[["key", "response"]]

        return requests.mapInPandas(run, "key string, response string")

    def asked(self):
        out = {}
        for name in os.listdir(self.path):
            with open(os.path.join(self.path, name), encoding="utf-8") as text:
                out[name] = len(text.read())
        return out


def test_each_request_is_asked_once_a_try(spark, tmp_path):
    model = Counting(str(tmp_path), lambda k, n: f"ok{k}" if k % 4 < n else (None if k % 2 else "no"))
    items = spark.createDataFrame([(str(i), "p") for i in range(40)], "key string, prompt string").repartition(3)
    read = lambda r: F.when(r.startswith("ok"), r)
    journal = shared_path(spark, "journal")
    for _ in range(2):
        got = batch.labelled(items, model, read, 3, journal)
        for _ in range(2):
            assert {r["key"]: (r["attempts"], r["answer"]) for r in got.collect()} == {str(i): (min(i % 4 + 1, 3), f"ok{i}" if i % 4 < 3 else None) for i in range(40)}
    want = {f"{n}-{i}" for i in range(40) for n in (1, 2, 3) if i % 4 >= n - 1}
    assert model.asked() == dict.fromkeys(want, 1)


def test_a_model_that_varies_gives_each_item_one_row(spark):
    items = spark.range(50).select(F.col("id").cast("string").alias("key"), F.lit("p").alias("prompt"))
    got = batch.labelled(items, lambda r, n: r.select("key", F.when(F.rand() < 0.5, "ok").otherwise("no").alias("response")), lambda r: F.when(r == "ok", r))
    assert got.count() == 50 and got.select("key").distinct().count() == 50


def test_cache_reads_the_buckets_of_its_requests(spark, tmp_path):
    model = Counting(str(tmp_path), lambda k, n: None if k % 10 == 3 else f"a{k}" * 50)
    every = spark.range(2000).select(F.col("id").cast("string").alias("key"), F.lit("p").alias("prompt"))
    cache = shared_path(spark, "cache")
    first = {r["key"]: r["source"] for r in batch.cached(every, model, cache).collect()}
    assert len(first) == 2000 and set(first.values()) == {"network"}
    few = every.where("key in ('1', '2', '3', '5')").unionByName(every.where("key = '5'"))
    before = len(model.asked())
    got = batch.cached(few, model, cache)
    found = sorted((r["key"], r["source"], r["response"] is None) for r in got.collect())
    assert found == [("1", "cache", False), ("2", "cache", False), ("3", "network", True), ("5", "cache", False), ("5", "cache", False)]
    assert len(model.asked()) == before and model.asked()["1-3"] == 2 and model.asked()["1-5"] == 1
    folders = {d for d in os.listdir(cache.removeprefix("file://")) if d.startswith("bucket=")}
    assert len(folders) > 200
    own = {"bucket=" + hashlib.sha256(f"{k}|p".encode()).hexdigest()[:2] for k in (1, 2, 3, 5)}
    scan = spark.read.schema("cache_key string, response string, bucket string").parquet(cache).where(F.col("bucket").isin(*[o[7:] for o in own]))
    assert {p.split("/")[-2] for p in scan.inputFiles()} <= folders and own <= folders


def test_books_are_read_in_their_order(spark, tmp_path):
    pages = [(f"c{i}.xhtml", f"<html><head><title>t</title></head><body>Chapter {i}</body></html>") for i in range(1, 13)]
    shuffled = sorted(pages)
    order = [f"c{i}.xhtml" for i in range(1, 12)]
    path = tmp_path / "book.epub"
    path.write_bytes(books.pack_epub(shuffled, order))
    text = books.read_book(spark, str(path)).first()["text"]
    assert text.split("\n\n") == [f"Chapter {i}." for i in range(1, 13)]
    rows = books.epub_chapters(spark.createDataFrame([("b", path.read_bytes())], "path string, content binary")).collect()
    assert [(r["place"], r["name"]) for r in rows] == [(i - 1, f"OPS/c{i}.xhtml") for i in range(1, 13)]


def test_books_without_text_are_errors(spark):
    def archive(**files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as book:
            for name, data in files.items():
                book.writestr(name.replace("__", "/"), data)
        return out.getvalue()

    for content in (books.pack_epub([("a.xhtml", "<p> </p>")]), books.pack_epub([]), b"no archive", b"", None, archive(a="x"), archive(META_INF__x="<a/>")):
        with pytest.raises(books.BookError):
            books.epub_pages(content)
        with pytest.raises(Exception, match="bad.epub"):
            books.epub_chapters(spark.createDataFrame([("bad.epub", content)], "path string, content binary")).collect()
    navigation = books.pack_epub([("nav.xhtml", "<p>list</p>"), ("a b.xhtml", "<p>text</p>")], ["a b.xhtml"])
    assert books.epub_pages(navigation) == [("OPS/a b.xhtml", "text"), ("OPS/nav.xhtml", "list")]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_schema_of_a_card(spark):
    def good(indices, text="d", examples=("e",)):
        made = F.array(*map(F.lit, examples)) if examples else F.expr("cast(array() as array<string>)")
        return value(spark, qc.valid_schema({"definition_en": F.lit(text), "lemma": F.lit("w")}, made, F.lit(indices)))

    assert good("[1, 2]") and good("[]") and good(" [-3] ")
    assert not any((good('["1"]'), good("[1.5]"), good(None), good("1"), good("[1]", " "), good("[1]", None), good("[1]", "d", ())))


def test_lemma_in_text(spark):
    def held(lemma, text):
        return value(spark, qc.lemma_in_text(F.lit(lemma), F.lit(text)))

    assert held("go", "She went home") and held("act", "a reaction") and held("Try", "he tried") and not held("go", "He came") and held("go", None) is False


def test_share_and_findings(spark):
    rows = spark.createDataFrame([(1, "a 882"), (2, ""), (3, "the cat's 1882"), (4, None)], "k int, t string")
    got = qc.share_check(rows, F.col("t") == "", 0.2).first()
    assert (got["total"], got["failures"], got["rate"], got["passed"]) == (4, 1, 0.25, False)
    none = qc.share_check(rows.where("false"), F.col("t") == "", 0.0).first()
    assert (none["total"], none["failures"], none["rate"], none["passed"]) == (0, 0, 0.0, True)
    found = qc.findings(rows, "k", "t", parts=("882",), words=("cat", "the"), equal=("",)).collect()
    assert sorted(map(tuple, found)) == [(1, "part", "882"), (2, "equal", ""), (3, "part", "882"), (3, "word", "cat"), (3, "word", "the")]


def test_spans_that_miss_their_word(spark):
    rows = spark.createDataFrame([("a cat sat", "cat", 1), ("a cat sat", "dog", 1), (None, "cat", 0), ("", "x", 0)], "sentence string, surface string, position int")
    assert sorted(str(r["surface"]) for r in gold.span_mismatches(rows).collect()) == ["cat", "dog", "x"]


def test_vectors_of_near_texts_are_near(spark):
    from glossmill import records

    def shout():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    texts = ["counting the old lamps", "counted the old lamp", "zebra quickly", "", None, "!!"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, text string")
    store = shared_path(spark, "vectors")
    got = {r["key"]: r["vector"] for r in records.embedded(rows, store, records.subwords).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b]))
    assert all(len(v) == records.DIMENSIONS for v in got.values()) and abs(dot("0", "0") - 1) < 1e-9
    assert dot("0", "1") > dot("0", "2") + 0.2 and got["3"] == got["4"] == got["5"] == [0.0] * records.DIMENSIONS
    again = records.embedded(rows.where("key = '1'"), store, records.subwords).first()
    assert again["source"] == "cache" and again["vector"] == got["1"]
    made = {r["key"]: r["vector"] for r in records.embedded(rows, shared_path(spark, "other"), records.by_model(shout)).collect()}
    assert made["2"] == [13.0, 1.0] and made["4"] == [0.0, 1.0]


def test_phrases_with_examples(spark):
    stats = spark.createDataFrame([("give up", 3), ("look up", 1)], "phrasal string, book_freq int")
    found = spark.createDataFrame([("give up", 1), ("give up", 1), ("give up", 2)], "phrasal string, sentence_id int")
    sents = spark.createDataFrame([(1, "x" * 100), (2, "y" * 99), (3, "z")], "sentence_id int, sentence string")
    got = {r["phrasal"]: r["example"] for r in examples.for_phrases(stats, found, sents).collect()}
    assert got == {"give up": "x" * 100 + examples.JOINER + "y" * 99, "look up": None}


def test_known_words_may_come_from_their_own_store(spark):
    from glossmill.sources import tables

    store = tables.known_words(spark, shared_path(spark, "known"))
    assert not store.exists()
    store.save(spark.createDataFrame([(f"w{i}", "known") for i in range(50)], "lemma string, status string").repartition(4))
    store.save(store.load().where("lemma <> 'w7'").withColumn("status", F.lit("learning")))
    assert store.load().count() == 49 and store.load().select("status").distinct().collect()[0][0] == "learning"
