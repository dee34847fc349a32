"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words (A-Z lowered, cut at every ASCII character that is
no letter or digit) joined by single spaces.  A window is ``window`` consecutive
words of a benchmark item; a shorter item is one window.  All windows go into one
automaton, with a space on either side so that matches respect words, and each
document is scanned once.  A match's end gives the word it ends at, so hits are
runs of words; ``spans`` maps them back to code points of the original text.

The automaton is broadcast only while the windows take at most
``max_window_bytes``, which is measured first.  A larger benchmark is dealt into
blocks of windows under that bound; each block is scanned over all documents and
the partial results are joined by the digest of the text, so nothing is dropped.

Defined cases: a null or wordless document has no words and no hits; null and
wordless items have no windows; items of equal text each count; equal item_ids
count once; items without an id count as one item, whose words are hit like any
other's and which stands as a null last in the list of items and in no digest;
empty tables give empty or clean results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import materialize, shielded, small_batches, table, text_or_empty, unshielded

#: Byte map: A-Z to a-z, other ASCII that is no letter or digit to a space.
_MAP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SCHEMA = "n_words long, n_hit long, items array<string>, starts array<long>, stops array<long>"


def words_of(text: str | None) -> list[str]:
    """The normalised words of a text."""
    return [w.decode() for w in (text or "").encode().translate(_MAP).split()]


def windows_of(words: list[str], window: int) -> list[str]:
    """The windows of an item's words, each joined by spaces."""
    if not words:
        return []
    return [" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


class Scanner:
    """One automaton over (window, item ids) pairs."""

    def __init__(self, windows: dict[str, list[str]]):
        self.items = list(windows.values())
        self.machine = ahocorasick.Automaton()
        for i, text in enumerate(windows):
            self.machine.add_word(f" {text} ", (i, text.count(" ") + 1))
        if self.items:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, int, list[str], list[int], list[int]]:
        """Words, hit words, ids of items met, and the hit runs as half-open word ranges."""
        words = words_of(text)
        if not words or not self.items:
            return len(words), 0, [], [], []
        line = f" {' '.join(words)} "
        found = [(end, i, n) for end, (i, n) in self.machine.iter(line)]
        if not found:
            return len(words), 0, [], [], []
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        last = np.searchsorted(ends, np.array([f[0] for f in found])) + 1
        mark = np.zeros(len(words) + 1, np.int64)
        np.add.at(mark, last - np.array([f[2] for f in found]), 1)
        np.add.at(mark, last, -1)
        hit = np.concatenate(([False], np.cumsum(mark)[:-1] > 0, [False]))
        edges = np.nonzero(hit[1:] != hit[:-1])[0]
        items = sorted({x for i in {f[1] for f in found} for x in self.items[i]}, key=lambda x: (x is None, x))
        return len(words), int(hit.sum()), items, edges[::2].tolist(), edges[1::2].tolist()


def spans(text: str, starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """Word ranges of a text as half-open code point ranges of the original."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in zip(starts, stops)]


def _window_table(items: DataFrame, window: int) -> DataFrame:
    """(text, ids): every distinct window with the sorted ids of its items, as strings."""
    small_batches(items.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sorted(set(windows_of(words_of(text), window)))
                ids += [item] * len(own)
                texts += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["id", "text"])

    source = items.select(F.col("item_id").cast("string").alias("id"), text_or_empty().alias("text"))
    # Sets leave nulls out, but not in a struct.
    ids = F.array_sort(F.transform(F.collect_set(F.struct("id")), lambda x: x["id"])).alias("ids")
    return source.mapInArrow(cut, "id string, text string").groupBy("text").agg(ids)


def _scan(docs: DataFrame, rows: list, keep: list[str]) -> DataFrame:
    """``docs`` columns ``keep`` with the scan of their ``text`` against collected windows."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({r["text"]: list(r["ids"]) for r in rows})
    small_batches(spark)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in batches:
            n, hit, items, starts, stops = [], [], [], [], []
            for text in batch.column(len(keep)).to_pylist():
                for out, value in zip((n, hit, items, starts, stops), scanner.scan(text)):
                    out.append(value)
            own = [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string()))]
            own += [pa.array(x, pa.list_(pa.int64())) for x in (starts, stops)]
            names = [*keep, "n_words", "n_hit", "items", "starts", "stops"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *own], names=names)

    source = docs.select(*keep, text_or_empty().alias("__text"))
    return source.mapInArrow(run, ", ".join([*kinds, _SCHEMA]))


def _merge_runs(starts: list[int], stops: list[int]) -> tuple[list[int], list[int]]:
    a, b = [], []
    for lo, hi in sorted(zip(starts, stops)):
        if b and lo <= b[-1]:
            b[-1] = max(b[-1], hi)
        else:
            a.append(lo)
            b.append(hi)
    return a, b


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = 10, max_window_bytes: int = 64 << 20) -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` (doc_id, text, ..) with what the benchmark hits.

    Adds n_words, n_hit, items (sorted ids, strings) and the runs of hit words
    (``starts``, ``stops``).
    """
    windows = materialize(_window_table(benchmark, window), "decontam-windows")
    size = windows.agg(F.sum(F.length("text") + F.size("ids") * 8)).first()[0] or 0
    blocks = -(-size // max_window_bytes)
    if blocks <= 1:
        return _scan(docs, windows.collect(), keep)
    texts = docs.select(text_or_empty().alias("text"))
    parts = None
    for k in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        part = _scan(texts.withColumn("key", F.sha2("text", 256)), rows, ["key"])
        part = part.where("n_hit > 0").dropDuplicates(["key"])
        parts = part if parts is None else parts.unionByName(part)
    parts = materialize(parts, "decontam-parts")

    def join(key, frame):
        import pandas as pd

        a, b = _merge_runs([x for s in frame["starts"] for x in s], [x for s in frame["stops"] for x in s])
        items = sorted({x for s in frame["items"] for x in s}, key=lambda x: (x is None, x))
        return pd.DataFrame({"__key": [key[0]], "n_hit": [sum(b) - sum(a)], "items": [items], "starts": [a], "stops": [b]})

    merged = parts.groupBy("key").applyInPandas(join, "__key string, n_hit long, items array<string>, starts array<long>, stops array<long>")
    counts = _scan(docs.withColumn("__key", F.sha2(text_or_empty(), 256)), [], [*keep, "__key"]).select(*keep, "__key", "n_words")
    empty = "cast(array() as array<%s>)"
    return counts.join(merged, "__key", "left").select(
        *keep,
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.expr(empty % "string")).alias("items"),
        F.coalesce("starts", F.expr(empty % "long")).alias("starts"),
        F.coalesce("stops", F.expr(empty % "long")).alias("stops"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows in which any window of the benchmark occurs."""
    safe, names = shielded(docs)
    return unshielded(scan(safe, benchmark, names, window).where("n_hit = 0"), names, docs.columns)


def op3_decontam(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` and ``benchmark`` tables."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def digest_of(items: list[str]) -> str:
    """The digest of a set of item ids: sorted as strings, joined by commas."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(ws)) AS n, list_slice(ws, i, i + least(10, len(ws)) - 1) AS win
       FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)),
m AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON h.doc_id = w.doc_id LEFT JOIN it ON it.doc_id = w.doc_id
"""
