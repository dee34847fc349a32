"""Fill-in-middle, filter audit and byte-pair encoding against brute force on small tables."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import public_tokenizers as installed
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from conftest import SF
from glossmill.llm import bpe_tree, filter_audit, fim

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, part string, mask string, form string, h1 string, digest string"
PATH = installed.path("word_bpe_49k.json")


def frame(spark, texts, ids=None, sources=None):
    """Documents with columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    data = [(i, t, "en", s, len(t or ""), "a", "b", "c", "d", "e", "f") for i, t, s in zip(ids, texts, sources)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(300)}" for _ in range(n))


ODD = ["", None, "  \n", "x", " x", "x ", "ünï cödé ★ 漢字 😀 " * 9, words(9000, 1), words(40, 2), words(40, 2), "a<P>b", "<S>", "<M> <M>", "< P>"]
ODD_IDS = [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 10, None, None, 13]


# 11. fill in the middle


def plain_fim(doc_id, text):
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(tokens)
    digits = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_matches_plain_cutting(spark):
    ids, texts = zip(*duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    for ids, texts in ((ids, texts), (ODD_IDS, ODD), (range(500, 600), ODD[:10] * 10)):
        docs = frame(spark, texts, ids)
        out = fim.fill_in_middle(docs).withColumn("text", fim.restored()).collect()
        got = sorted((repr(r["doc_id"]), *map(repr, (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text"]))) for r in out)
        want = sorted((repr(i), *map(repr, (*plain_fim(i, t), t or ""))) for i, t in zip(ids, texts))
        assert got == want
    assert {r.split("'")[1] for r in (w[2] for w in want)} == {"plain", "psm", "spm"}


@given(st.text(st.sampled_from(" \t\n\x0b\x1c ab<>PSMé漢😀"), max_size=30), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(0, 99))
@settings(max_examples=300, deadline=None)
def test_fim_borders_and_pieces(text, h1, h2, h4):
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    assert fim.borders(fim.points(text)).tolist() == np.cumsum([0, *map(len, tokens)]).tolist()
    n, form, prefix, middle, output = fim.Cutter(fim.Marks(), 50, 80)(text, (h1, h2, 0, h4))
    assert n == len(tokens)
    if form == "psm":
        body = output[3:]
        assert text == body[:prefix] + body[len(body) - middle :] + body[prefix + 3 : len(body) - middle - 3]


def test_fim_of_other_marks_ids_and_rates(spark):
    docs = spark.createDataFrame([("a", "one two three"), ("b", None), (None, "four five")], "doc_id string, text string")
    got = {r["doc_id"]: r for r in fim.fill_in_middle(docs, rate=100, suffix_first=0, marks=fim.Marks("[pre]", "[suf]", "[mid]")).collect()}
    assert got["a"]["form"] == got[None]["form"] == "psm" and got["a"]["output"].startswith("[pre]") and got["b"]["form"] == "plain"
    assert fim.fill_in_middle(docs.where("false")).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("<P>", ">S", "<M>"), ("", "<S>", "<M>"), ("<P>", "<S>", "<S>x"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError):
            fim.Marks(*bad)


# 12. filter audit


def plain_audit(rows, labels):
    """Every order applied to every document, one after another."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    fails = []
    for doc_id, text, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [i for i, t, _ in rows if (t or "") == text and i is not None]
        f = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)))
        e = doc_id is not None and min(same) < doc_id
        fails.append((source or "", doc_id, dict(zip("ABCDE", (*f, e)))))
    out = {}
    for part in {p for p, _, _ in fails}:
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                cell = [0] * 6
                for p, doc_id, f in fails:
                    if p != part:
                        continue
                    gone = any(f[x] for x in order[: step - 1])
                    cell[0] += not gone and not f[letter]
                    cell[1] += not gone and f[letter]
                    cell[2] += gone and f[letter]
                    cell[3] += f[letter] and sum(f.values()) == 1
                    cell[4] += not gone and f[letter] and doc_id in good
                    cell[5] += not gone and f[letter] and doc_id in toxic
                total[letter] += cell[1]
                out[part, order, step] = cell
        for (p, order, step), cell in out.items():
            if p == part:
                cell.append(total[order[step - 1]])
    return {k: tuple(map(int, v)) for k, v in out.items()}


def audited(spark, rows, labels):
    ids, texts, sources = zip(*rows)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame(spark, texts, ids, sources), known).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in filter_audit.COLUMNS) for r in got}
    assert len(found) == len(got)
    return found


def test_audit_matches_filters_applied_in_turn(spark):
    rng = random.Random(3)
    pool = [words(60, 5), words(60, 6) + " $", "ABC DEF", "a b c", "", None, " ".join(f"x{i}" for i in range(80)), "Q" * 9 + " w" * 70, "one word\x1conly"]
    rows = [(rng.choice([i, i, i, None, 7]), rng.choice(pool), rng.choice(["web", "web", "book", None, ""])) for i in range(40)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 40, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    assert audited(spark, rows, labels) == plain_audit(rows, labels)


def test_audit_of_hot_text_and_no_labels_or_rows(spark):
    rows = [(i, "same", "a" if i % 3 else "b") for i in range(300)]
    got = audited(spark, rows, [(299, 1, 1)])
    assert got["a", "EABCD", 1][1] == 200 and got["b", "EABCD", 1][1] == 99 and got["a", "EABCD", 1][4:6] == (1, 1)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(frame(spark, ["a"]).where("false"), none).count() == 0
    assert filter_audit.audit(frame(spark, ["a"]), none).count() == 600


# 13. byte-pair encoding by a tree


@pytest.fixture(scope="module")
def bpe():
    return bpe_tree.Bpe(PATH)


def test_encoding_matches_the_library(spark):
    library = Tokenizer.from_file(PATH)
    run = "".join(random.Random(1).choice("abcdefgh'ré漢😀!1") for _ in range(3000))
    more = ["J̌" * 400 + "x", run, f"a {run} b<|endoftext|>c", "<|startoftext|>" * 90, "ab" * 900 + "　" + "'re" * 300, "́ á" * 3, "a\x85b\xa0c\x1cd"]
    texts, ids = ODD + more + [run, run], [*ODD_IDS, *range(100, 100 + len(more)), None, None]
    docs = frame(spark, texts, ids)
    for leaf, window in ((bpe_tree.LEAF, bpe_tree.WINDOW), (7, 1), (100, 8)):
        out = bpe_tree.decode(bpe_tree.encode(docs, PATH, leaf, window), PATH).collect()
        got = sorted((repr(r["doc_id"]), bytes(r["ids"]), r["text"]) for r in out)
        want = []
        for i, text in zip(ids, texts):
            found = library.encode(text or "", add_special_tokens=False).ids
            want.append((repr(i), np.array(found, "<u4").tobytes(), library.decode(found, skip_special_tokens=False)))
        assert got == sorted(want)
    assert bpe_tree.encode(docs.where("false"), PATH).count() == 0


def test_tokens_of_the_smallest_table(spark):
    library = Tokenizer.from_file(PATH)
    want = {}
    for i, text in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall():
        found = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(found, skip_special_tokens=False)
        want[i] = (len(found), hashlib.sha256(np.array(found, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in bpe_tree.op13_bpe_tree(spark, SF).collect()} == want


@given(st.text(st.sampled_from("aabehinrst''''lmvd!?..19é漢😀́̈ "), max_size=90), st.integers(1, 9), st.integers(1, 6))
@settings(max_examples=1500, deadline=None)
def test_joined_leaves_are_the_encoding_of_the_whole(bpe, text, leaf, window):
    plain = bpe.whole.normalizer.normalize_str(text)
    pieces = [bpe_tree.Piece.encoded(bpe, plain[i : i + leaf]) for i in range(0, len(plain), leaf)]
    if pieces:
        got, want = bpe_tree.tree(bpe, pieces, window), bpe_tree.Piece.encoded(bpe, plain)
        for name in ("ids", "starts", "ends"):
            assert getattr(got, name).tolist() == getattr(want, name).tolist()


def test_windows_stay_small(bpe):
    """A join of long leaves encodes a few hundred characters, not the leaves."""
    text = "".join(random.Random(2).choice("etaoinshrdlu") for _ in range(20_000))
    seen = []


    halves = [bpe_tree.Piece.encoded(bpe, text[:10_000]), bpe_tree.Piece.encoded(bpe, text[10_000:])]
    encoded = bpe_tree.Piece.encoded
    try:
        bpe_tree.Piece.encoded = classmethod(lambda cls, b, t: seen.append(len(t)) or encoded(b, t))
        got = bpe_tree.joined(bpe, *halves)
    finally:
        bpe_tree.Piece.encoded = encoded
    assert sum(seen) < 2000 and got.ids.tolist() == bpe_tree.Piece.encoded(bpe, text).ids.tolist()


def test_words_forget_when_full(bpe):
    few = bpe_tree.Words(bpe.whole, 3)
    for batch in ([b"a", b"b"], [b"c", b"d"], [b"a", b"e", b"f", b"g", b"h"]):
        few.learn(batch)
        assert all(few[w] == bpe_tree.little(bpe.whole.encode(w.decode()).ids) for w in batch)


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, TypeError, KeyError, AttributeError)):
        bpe_tree.Bpe(installed.path("byte_bpe_50k.json"))
