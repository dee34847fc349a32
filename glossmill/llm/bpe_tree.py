"""Encoding and decoding with a byte-pair tokenizer that drops white space.

White space splits a text for such a tokenizer: what is before it and behind it
is encoded alike with or without the rest.  So a text is cut at ASCII white space
and its words are encoded once each in a worker, whatever their number.

A stretch without white space cannot be cut like that: a merge, a letter run or
the mark of a word's end may reach across any place.  A long one is normalised,
cut into leaves of equal length, and the leaves are dealt over all tasks and
encoded there in parallel.  The leaves of a text are then joined two by two, as
a tree.  At a join the ids next to it may be wrong on both sides, so a window of
text around it is encoded anew.  It grows until, on either side, two adjacent
tokens of the window are those of the side itself, at the same characters.

Why that is exact.  Merges run by rank and then by place, so a row of tokens is
the encoding of its text as soon as every two adjacent ones are the encoding of
theirs (the first merge across a border would also happen in the two alone).
Two adjacent tokens shared by side and window show this for the border, and show
that both split the text alike from there on: a token tells whether it ends a
word, and a splitting pattern that starts at the same character goes on alike.
Shared tokens count only if they end ``GUARD`` characters before the end of what
was encoded, as an open run or a contraction may go on there.  A window that has
reached the end of a side takes that side over whole.

Ids are little-endian unsigned 32-bit words in a binary column.

Defined cases: a null text counts as empty and has no ids; the strings of added
tokens are those tokens, as the library has it by default; equal and repeated
rows are encoded each, repeated long ones once a task; an id of any type is kept,
null too; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import parallelism, small_batches, table, text_or_empty

#: Characters of a leaf; a longer stretch without white space is cut.
LEAF = 1 << 14
#: Characters on each side of a join that are encoded first.
WINDOW = 64
#: The longest contraction that the splitting pattern looks ahead for, and one.
GUARD = 4
#: Words that a worker remembers, and bytes of a text that are split at a time.
KNOWN_WORDS, SLICE = 1 << 19, 1 << 20
#: Rows of a batch that are worked on at once, for memory.
ROWS = 64

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def little(ids) -> bytes:
    """Ids as little-endian 32-bit words."""
    words = array("I", ids)
    if sys.byteorder == "big":
        words.byteswap()
    return words.tobytes()


class Words(dict):
    """Ids of words as bytes, encoded when first met; it forgets all when it is full."""

    def __init__(self, tokenizer, size: int = KNOWN_WORDS):
        self.tokenizer, self.size = tokenizer, size

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in set(words) if w not in self]
        if len(self) + len(new) > self.size:
            self.clear()
            new = list(set(words))
        found = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        self.update(zip(new, (little(e.ids) for e in found)))


class Bpe:
    """A tokenizer file whose splits fall on white space, whole and without its normaliser."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        steps = spec["normalizer"].get("normalizers", [spec["normalizer"]])
        known = all(s["type"] in ("NFC", "Lowercase") or s.get("pattern") == {"Regex": r"\s+"} for s in steps)
        if not known or any(self.whole.encode(f"{s}a{s}", add_special_tokens=False).ids != self.whole.encode("a").ids for s in " \t\n\v\f\r"):
            raise ValueError(f"{path} does not drop white space")
        if any(_SPACE.search(t["content"].encode()) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that reach across white space")
        self.path = path
        self.cut_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or "(?!)")
        self.words = Words(self.whole)

    @cached_property
    def bare(self):
        """The tokenizer without its normaliser and added tokens, for texts that are normalised; made when a long stretch is met."""
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as source:
            spec = json.load(source)
        return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "added_tokens": []}))

    def ids(self, text: str) -> bytes:
        """Ids of a text whose stretches without white space are short."""
        raw = text.encode()
        out, at = [], 0
        while at < len(raw):
            end = len(raw)
            if at + SLICE < end and (space := _SPACE.search(raw, at + SLICE)):
                end = space.start()
            words = raw[at:end].split()
            self.words.learn(words)
            out += map(self.words.__getitem__, words)
            at = end
        return b"".join(out)

    def parts(self, text: str, leaf: int) -> Iterator[tuple[int, str]]:
        """(stretch, piece) in order: pieces of one stretch are to be joined, stretches only follow each other.

        A piece of an odd stretch is normalised text; that of an even one is raw.
        """
        stretch, at = 0, 0
        for run in re.finditer(r"[^\x20\x09-\x0D]{%d,}" % (leaf + 1), text):
            yield stretch, text[at : run.start()]
            at = run.start()
            for token in [*self.cut_added.finditer(run[0]), None]:
                start = run.start() + token.start() if token else run.end()
                plain = self.whole.normalizer.normalize_str(text[at:start])
                for i in range(0, len(plain), leaf):
                    yield stretch + 1, plain[i : i + leaf]
                stretch += 2
                if token:
                    yield stretch, token[0]
                    at = start + len(token[0])
            at = run.end()
        yield stretch, text[at:]


@lru_cache(maxsize=2)
def loaded(path: str) -> Bpe:
    """The tokenizer of a file, once a worker; it keeps to the task's core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Bpe(path)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``ROWS`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


class Piece:
    """A normalised text with its tokens: ids, and the characters where each starts and ends."""

    def __init__(self, text: str, ids, starts, ends):
        self.text, self.ids, self.starts, self.ends = text, ids, starts, ends

    @classmethod
    def encoded(cls, bpe: Bpe, text: str) -> Piece:
        found = bpe.bare.encode(text, add_special_tokens=False)
        at = np.array(found.offsets, np.int64).reshape(-1, 2)
        return cls(text, np.array(found.ids, np.uint32), at[:, 0], at[:, 1])

    def cut(self, first: int, last: int) -> tuple:
        return self.ids[first:last], self.starts[first:last], self.ends[first:last]


def shared(one: Piece, two: Piece, shift: int, low: int, high: int) -> tuple[int, int] | None:
    """Places (i, j) of a token of ``one`` and of ``two``, equal and each behind an equal one, or None.

    ``two`` begins ``shift`` characters after ``one``.  The tokens before the places
    end at a character's border, within ``low`` to ``high`` of ``one``.
    """
    first = bisect_left(one.starts, low)
    last = bisect_left(one.starts, high)
    keys = zip(one.ids[first : last + 1].tolist(), one.starts[first : last + 1].tolist(), one.ends[first : last + 1].tolist())
    places = {key: first + i for i, key in enumerate(keys)}
    own = list(zip(two.ids.tolist(), (two.starts + shift).tolist(), (two.ends + shift).tolist()))
    for j in range(1, len(own)):
        i = places.get(own[j])
        if i and places.get(own[j - 1]) == i - 1 and own[j - 1][2] <= min(own[j][1], high):
            return i, j
    return None


def joined(bpe: Bpe, left: Piece, right: Piece, window: int = WINDOW) -> Piece:
    """The piece of both texts together, by a window around their border that grows until both sides agree."""
    text = left.text + right.text
    border = len(left.text)
    while True:
        low, high = max(0, border - window), min(len(text), border + window)
        middle = Piece.encoded(bpe, text[low:high])
        begin = (0, 0) if low == 0 else shared(left, middle, low, low, border - GUARD)
        if high == len(text):
            end = (len(right.ids), len(middle.ids))
        else:
            end = shared(right, middle, low - border, 0, high - border - GUARD)
        if begin and end and begin[1] <= end[1]:
            break
        window *= 2
    new = middle.cut(begin[1], end[1])
    parts = zip(left.cut(0, begin[0]), (new[0], new[1] + low, new[2] + low), right.cut(end[0], None), (0, border, border))
    return Piece(text, *(np.concatenate((a, b, c + np.asarray(shift, c.dtype))) for a, b, c, shift in parts))


def tree(bpe: Bpe, pieces: list[Piece], window: int = WINDOW) -> Piece:
    """One piece of all, by joining neighbours until one is left."""
    while len(pieces) > 1:
        pairs = zip(pieces[::2], pieces[1::2])
        pieces = [joined(bpe, a, b, window) for a, b in pairs] + pieces[len(pieces) & ~1 :]
    return pieces[0]


def _encode_short(docs: DataFrame, path: str, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids = pa.array([loaded(path).ids(t) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.mapInArrow(run, f"doc_id {kind}, ids binary")


def _encode_long(docs: DataFrame, path: str, kind: str, leaf: int, window: int) -> DataFrame:
    """Rows with a long stretch: cut, encode the pieces on all tasks, and join those of a row."""
    names = ["doc_id", "digest", "task", "copies", "part", "stretch", "piece"]
    schema = f"doc_id {kind}, digest binary, task int, copies long, part int, stretch int, piece string"
    kinds = (("ids", np.dtype("<u4")), ("starts", np.dtype("<i8")), ("ends", np.dtype("<i8")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column("text").to_pylist()):
                stretches, pieces = zip(*loaded(path).parts(text, leaf))
                keys = batch.select(names[:4]).take(pa.array([row] * len(pieces), pa.int64()))
                own = (pa.array(range(len(pieces)), pa.int32()), pa.array(stretches, pa.int32()), pa.array(pieces))
                yield pa.RecordBatch.from_arrays([*keys.columns, *own], names=names)

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in sliced(batches):
            found: list[list] = [[], [], []]
            for stretch, text in zip(batch.column("stretch").to_pylist(), batch.column("piece").to_pylist()):
                piece = Piece.encoded(bpe, text) if stretch % 2 else None
                for column, (name, dtype) in zip(found, kinds):
                    column.append(getattr(piece, name).astype(dtype).tobytes() if piece else None)
                if not piece:
                    found[0][-1] = bpe.ids(text)
            columns = [*batch.columns, *(pa.array(c, pa.binary()) for c in found)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *(name for name, _ in kinds)])

    def join(rows: pa.Table) -> pa.Table:
        stretches: dict[int, list[dict]] = {}
        for row in rows.sort_by("part").select(["stretch", "piece", *(name for name, _ in kinds)]).to_pylist():
            stretches.setdefault(row["stretch"], []).append(row)
        out = []
        for stretch, pieces in stretches.items():
            if stretch % 2:
                leaves = [Piece(p["piece"], *(np.frombuffer(p[name], dtype) for name, dtype in kinds)) for p in pieces]
                out.append(tree(loaded(path), leaves, window).ids.astype("<u4").tobytes())
            else:
                out += [p["ids"] for p in pieces]
        return rows.select(["doc_id", "copies"]).slice(0, 1).append_column("ids", pa.array([b"".join(out)], pa.binary()))

    rows = (
        docs.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"), F.spark_partition_id().alias("task"))
        .groupBy("doc_id", "digest", "task")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    )
    dealt = rows.mapInArrow(cut, schema).repartition(parallelism(docs.sparkSession), "doc_id", "digest", "task", "part")
    encoded = dealt.mapInArrow(encode_pieces, f"{schema}, ids binary, starts binary, ends binary")
    whole = encoded.groupBy("doc_id", "digest", "task").applyInArrow(join, f"doc_id {kind}, copies long, ids binary")
    return whole.select("doc_id", "ids", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "ids")


def encode(docs: DataFrame, path: str, leaf: int = LEAF, window: int = WINDOW) -> DataFrame:
    """(doc_id, ids) of every row, as the tokenizer of the file encodes its text without special tokens."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    longest = F.array_max(F.transform(F.split("text", r"[\x20\x09-\x0D]"), F.length))
    unsplit = (F.length("text") > leaf) & (longest > leaf)
    return _encode_short(docs.where(~unsplit), path, kind).unionAll(_encode_long(docs.where(unsplit), path, kind, leaf, window))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of every row of ``encoded``, as the tokenizer decodes ids with special tokens kept."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in sliced(batches):
            rows = [np.frombuffer(b, "<u4").tolist() for b in batch.column(1).to_pylist()]
            texts = tokenizer.decode_batch(rows, skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, text string")


def op13_bpe_tree(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    import public_tokenizers as installed

    path = installed.path("word_bpe_49k.json")
    return decode(encode(table(spark, sf_dir, "documents"), path), path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
