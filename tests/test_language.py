"""Lemmas, forms, phrasal verbs and constructions on words and sentences with known outcomes."""

import pytest
from pyspark.sql import functions as F

from glossmill import inflection, lexicon
from glossmill.operators import constructions, mwe, qc, senses, stats, tokens

#: form lemma, by the rules of endings and the irregular classes.
LEMMAS = """
runs run, ran run, running run, men man, women woman, looked look, stopped stop, hoped hope, hoping hope, hopping hop, tried try, tries try, dies die,
died die, dying die, boxes box, houses house, classes class, churches church, goes go, heroes hero, shoes shoe, loved love, believed believe,
argued argue, danced dance, handled handle, charged charge, changed change, longed long, raised raise, passed pass, created create, repeated repeat,
managed manage, imagined imagine, explained explain, required require, entered enter, opening open, visiting visit, telling tell, added add, making make,
gave give, giving give, taken take, thing thing, king king, morning morning, glass glass, famous famous, cats cat, babies baby, played play, needed need,
agreed agree, used use, leaves leaf, wolves wolf, children child, better good, worst bad, went go, gone go, broke break, written write, sitting sit,
beginning begin, carried carry, smiled smile, staring stare, starred star, noticed notice, lives life, wanted want, decided decide, invited invite,
planned plan, referring refer, happened happen, controlled control, travelled travel, aged age, begged beg, judged judge, bridges bridge,
feet foot, mice mouse, people person, news news, hundred hundred, always always, bus bus, buses bus, was be, is be, has have, did do, caught catch,
"""


def lemmas(spark, words, pos=None):
    """The annotator's lemma of each word, as the first of a sentence."""
    sents = spark.createDataFrame([("1", i, w) for i, w in enumerate(words)], "book string, sentence_id long, sentence string")
    got = tokens.RegexAnnotator().tokens(sents).where("position = 0").collect()
    return {r["surface"]: (r["lemma"] if pos is None else r["pos"]) for r in got}


def test_lemmas_of_known_words(spark):
    want = dict(pair.split() for pair in LEMMAS.replace("\n", " ").split(",") if pair.strip())
    assert lemmas(spark, want) == want
    tags = lemmas(spark, ["ran", "men", "better", "quickly", "walked"], "pos")
    assert tags == {"ran": "VERB", "men": "NOUN", "better": "ADJ", "quickly": "ADV", "walked": "VERB"}


def test_lemmas_leave_names_and_closed_words(spark):
    sents = spark.createDataFrame([("1", 0, "So James Woods runs during his évolués"), ("1", 1, None), ("1", 2, "")], "book string, sentence_id long, sentence string")
    got = {r["surface"]: r["lemma"] for r in tokens.RegexAnnotator().tokens(sents).collect()}
    assert got == {"So": "so", "James": "james", "Woods": "woods", "runs": "run", "during": "during", "his": "his", "évolués": "évolués"}
    own = spark.createDataFrame([("runs", "sprint", "VERB")], "form string, lemma string, pos string")
    got = {r["surface"]: (r["lemma"], r["pos"]) for r in tokens.RegexAnnotator(own).tokens(sents).where("position = 3").collect()}
    assert got == {"runs": ("sprint", "VERB")}


def test_forms_of_one_word_are_one_lemma_in_statistics(spark):
    docs = spark.createDataFrame([(1, "They ran home. She runs fast. Please run."), (2, "Running is fun.")], "doc_id long, text string")
    got = {r["lemma"]: (r["book_freq"], r["doc_count"]) for r in stats.lemma_frequency(tokens.tokenize(docs)).collect()}
    assert got["run"] == (4, 4) and "runs" not in got and "ran" not in got


def test_irregular_dimension_has_one_row_a_form(spark):
    rows = inflection.irregular_rows()
    assert len({f for f, *_ in rows}) == len(rows) and len(rows) > 300
    fixed = dict((f, w) for f, w, _ in rows)
    for form, lemma in {"blew": "blow", "caught": "catch", "clung": "cling", "hung": "hang", "threw": "throw", "became": "become", "swollen": "swell", "oxen": "ox", "knives": "knife"}.items():
        assert fixed[form] == lemma
    more = inflection.irregular(spark, [("ran", "rann", "NOUN"), ("xen", "xo", "NOUN")])
    assert {r["form"]: r["lemma"] for r in more.where("form in ('ran', 'xen')").collect()} == {"ran": "rann", "xen": "xo"}


@pytest.mark.parametrize(
    ("word", "some"),
    [
        ("run", "run runs running ran"),
        ("walk", "walks walked walking"),
        ("make", "makes making made"),
        ("try", "tries tried trying"),
        ("go", "goes going went gone"),
        ("bad", "worse worst"),
        ("become", "became becomes"),
        ("hang", "hung hanged hangs"),
        ("throw", "threw thrown throws"),
        ("stop", "stopped stopping"),
        ("large", "larger largest"),
        ("happy", "happier happiest"),
        ("man", "men"),
    ],
)
def test_all_forms(spark, word, some):
    words = spark.createDataFrame([(word.upper(),)], "lemma string")
    forms = set(inflection.all_forms(words, inflection.irregular(spark)).first()["forms"])
    assert set(some.split()) <= forms
    own = set(spark.range(1).select(inflection.irregular_forms(F.lit(word)).alias("x")).first()["x"])
    regular = set(spark.range(1).select(inflection.word_forms(F.lit(word)).alias("x")).first()["x"])
    assert own | regular == forms


def test_examples_with_irregular_forms_hold_the_lemma(spark):
    def missing(lemma, example):
        return spark.range(1).select(qc.lemma_missing(F.lit(lemma), F.array(F.lit(example))).alias("x")).first()["x"]

    assert not missing("go", "He went home") and not missing("blow", "the wind blew") and missing("go", "He came home")


def test_lemma_index_takes_attested_words(spark):
    words = spark.createDataFrame([(w,) for w in "hope hoped hop hopped hoping ran running run zed zeds numbers number numb larger large a as".split()], "form string")
    irregulars = inflection.irregular(spark)
    got = {r["form"]: r["lemma"] for r in inflection.lemma_index(words, irregulars).collect()}
    assert got == {
        "hoped": "hope", "hopped": "hop", "hoping": "hope", "ran": "run", "running": "run", "zeds": "zed", "numbers": "number", "number": "numb", "larger": "large",
    }
    known = spark.createDataFrame([("hop",), ("Large",), (None,)], "lemma string")
    got = {r["form"]: r["lemma"] for r in inflection.lemma_index(words, irregulars, known).collect()}
    assert got == {"hopped": "hop", "ran": "run", "larger": "large"}
    assert inflection.lemma_index(words.where("false"), irregulars).count() == 0


PHRASES = [
    ("I need to look up the answer.", "look up"),
    ("The plane took off at noon.", "take off"),
    ("Don't give up on your dreams.", "give up"),
    ("The car broke down on the highway.", "break down"),
    ("She gave the old lamp up.", "give up"),
    ("He picked it up.", "pick up"),
    ("They turned the very loud music down.", "turn down"),
    ("They turned the loud old music down.", "turn down"),
    ("We look at the picture.", None),
    ("He gave, up there, a speech.", None),
    ("They gave money and hope up.", None),
    ("She gave the up.", None),
    ("He gave it all to the three poor old men up.", None),
    ("The lookup table is ready.", None),
    ("It was running out.", "run out"),
]


def test_phrasal_verbs_with_objects_between(spark):
    sents = spark.createDataFrame([("b", i, s) for i, (s, _) in enumerate(PHRASES)], "book string, sentence_id long, sentence string")
    pairs = lexicon.phrasal_pairs(spark)
    want = {i: p for i, (_, p) in enumerate(PHRASES) if p}
    found = mwe.phrasal_verbs(sents, pairs)
    assert {r["sentence_id"]: r["phrasal"] for r in found.collect()} == want and found.count() == len(want)
    stored = tokens.RegexAnnotator().tokens(sents)
    again = mwe.phrasal_verbs_of_tokens(stored, pairs, verbs_only=False)
    assert {r["sentence_id"]: r["phrasal"] for r in again.collect()} == want
    tagged = mwe.phrasal_verbs_of_tokens(stored.withColumn("pos", F.when(F.col("lemma").isin("give", "look"), "NOUN").otherwise(F.col("pos"))), pairs)
    assert {"give up", "look up"}.isdisjoint(r["phrasal"] for r in tagged.collect()) and tagged.count() > 0
    plan = mwe.phrasal_verbs(sents, pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(book") == 1 and "SortMergeJoin" not in plan and "Window" not in plan and "Python" not in plan
    long = spark.createDataFrame([("b", 1, "They gave " + "it " * 20000 + "up")], "book string, sentence_id long, sentence string")
    assert mwe.phrasal_verbs(long, pairs).count() == 0
    assert mwe.phrasal_verbs(sents.where("false"), pairs).count() == 0


def test_first_phrase_of_an_items_own_verb(spark):
    rows = [(1, "give", "Look out or she gives it away and gives up"), (2, "run", "I need to look up the answer"), (3, "take", None), (4, "look", "looking it up and over")]
    items = spark.createDataFrame(rows, "item int, lemma string, sentence string")
    got = {r["item"]: (r["verb"], r["particle"]) for r in mwe.phrases_of_items(items, lexicon.phrasal_pairs(spark)).collect()}
    assert got == {1: ("give", "away"), 4: ("look", "up")}


CASES = [
    ("I am going to finish this today.", "go", "BE_GOING_TO"),
    ("I'm gonna do it later.", "go", "GONNA"),
    ("Come on, let's go!", "come", "COME_ON"),
    ("Please go on with your story.", "go", "GO_ON"),
    ("Make sure you lock the door.", "make", "MAKE_SURE"),
    ("I called up my friend yesterday.", "call", "CALL_UP"),
    ("I go to the store every day.", "go", None),
    ("I am going to the store.", "run", None),
    ("Look over there", "over", "OVER_THERE"),
    ("She gave the plan up.", "give", "PHRASAL_GIVE_UP"),
    ("We look up to him.", "look", "LOOK_UP_TO"),
]


def guided(spark, cases, patterns=constructions.CONSTRUCTIONS):
    items = spark.createDataFrame([(i, w, s) for i, (s, w, *_) in enumerate(cases)], "item int, lemma string, sentence string")
    pairs = lexicon.phrasal_pairs(spark)
    return constructions.guidance(constructions.detect(items, constructions.table(spark, patterns)), mwe.phrases_of_items(items, pairs), pairs)


def test_guidance_of_known_sentences(spark):
    got = {r["item"]: r for r in guided(spark, CASES).collect()}
    assert {i: r["construction"] for i, r in got.items()} == {i: c for i, (_, _, c) in enumerate(CASES) if c}
    assert got[0]["policy"] == "SKIP" and got[8]["prefer_synsets"] == ["over.r.01"] and got[9]["prefer_synsets"] == ["surrender.v.01", "give_up.v.01"]
    assert got[3]["prefer_supersenses"] == ["verb.stative", "verb.communication"] and got[3]["forbid_supersenses"] == []


def test_longest_pattern_comes_first(spark):
    items = spark.createDataFrame([(1, "go", "He is going to go on."), (2, "go", None)], "item int, lemma string, sentence string")
    found = constructions.detect(items, constructions.table(spark)).orderBy("place").collect()
    assert [(r["construction"], r["start"], r["stop"]) for r in found] == [("BE_GOING_TO", 3, 14), ("GO_ON", 15, 20)]
    with pytest.raises(ValueError, match="policy"):
        constructions.table(spark, [("X", "x", "IGNORE", "x", {})])


def test_policies_change_the_choice(spark):
    rules = (
        ("NONE", "a", "SKIP", "skip", {}),
        ("NOT_FOOD", "a", "CONSTRAIN", "forbid", {"forbid_supersenses": ["noun.food"]}),
        ("NOT_ANY", "a", "CONSTRAIN", "nothing", {"forbid_supersenses": ["noun.food", "noun.act"]}),
        ("LIKE", "a", "CONSTRAIN", "tie", {"prefer_synsets": ["a.2"]}),
        ("TAKE", "a", "OVERRIDE", "take", {"prefer_synsets": ["gone", "a.3", "a.2"]}),
        ("TAKE_GONE", "a", "OVERRIDE", "absent", {"prefer_synsets": ["gone"]}),
    )
    sentences = ["skip", "forbid", "nothing", "tie", "take", "absent", "plain"]
    rows = guided(spark, [(s, "a") for s in sentences], rules)
    senses_ = [("a.1", "noun.food", 0, [1.0, 0.0]), ("a.2", "noun.act", 1, [0.6, 0.8]), ("a.3", "noun.act", 2, [-1.0, 0.0])]
    query = {"tie": [0.8944271909999159, 0.4472135954999579]}
    pairs = spark.createDataFrame(
        [(i, s, c, r, query.get(t, [1.0, 0.0]), g) for i, t in enumerate(sentences) for s, c, r, g in senses_],
        "item int, synset_id string, supersense string, rank int, query array<double>, gloss array<double>",
    )
    pairs = pairs.withColumn("gloss", F.when((F.col("item") == 3) & (F.col("rank") == 1), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.col("gloss")))

    def choice(applied):
        return {sentences[r["item"]]: (r["synset_id"], r["sense_label"], r["construction_tag"]) for r in senses.choose_guided(pairs, rows, "item", applied=applied).collect()}

    told = choice(("SKIP",))
    assert told["skip"] == (None, "construction", "NONE")
    assert {told[s][0] for s in sentences[1:]} == {"a.1"} and told["take"][2] == "TAKE" and told["plain"] == ("a.1", "noun.food", None)
    full = choice(constructions.POLICIES)
    assert full["forbid"] == ("a.2", "noun.act", "NOT_FOOD") and full["nothing"] == (None, "unknown", "NOT_ANY")
    assert full["tie"][0] == "a.2" and full["take"] == ("a.3", "noun.act", "TAKE") and full["absent"][0] == "a.1" and full["plain"][0] == "a.1"
    assert choice(())["skip"][0] == "a.1"
