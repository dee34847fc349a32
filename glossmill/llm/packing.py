"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Lengths are whole numbers from 1 to the capacity, so the instance is a histogram
of at most ``capacity`` rows however many documents there are; only that is
collected.  The reduction repeatedly takes the longest length left and fixes sets
that provably dominate every other way to fill its sequence (alone, with one
partner, or with two), in bulk over equal lengths.  What is left is packed
best-fit in decreasing length, again in bulk: sequences with the same contents
form one class with a multiplicity.  Placing one length splits at most one class
and opens at most two, so there are at most four classes a length.

The plan goes back to the documents by rank: the r-th piece of a length takes
the r-th place of that length.  Ranks come from counts per (length, salt), so a
length that holds a third of all pieces is still dealt over all tasks.

Defined cases: a null text counts as empty and is one end token; equal and
repeated rows are packed each; ties are broken by a hash of the row; an empty
table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import sys
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import materialize, parallelism, small_batches, table, text_or_empty

CAPACITY = 2048
END = 0
#: Any character but those on which both libraries are known to split alike.
_OTHER = re.compile(r"[^\x09\x0A\x0D\x20-\x7E\u00A1-\u024F]")


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level vocabulary: the tokenizer's file, the same tokens as ranks, and how it splits."""

    path: str
    ranks: str
    pattern: str


class Tokens:
    """Token ids of whole texts as little-endian 32-bit words.

    The ids are those of the tokenizer's file.  Texts of common characters take
    the ranks of the same vocabulary, which give the same ids in a sixth of the
    time; all others, and those that hold the string of an added token, go to the
    tokenizer itself with its default setting.
    """

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary.path)
        added = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)")
        with open(vocabulary.ranks, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        if _OTHER.search(text) or self.added.search(text):
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            found = self.quick.encode_ordinary(text)
        words = array("I", found)
        if sys.byteorder == "big":
            words.byteswap()
        return words.tobytes()


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter."""
    first = length % capacity if length > capacity else length
    first = first or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(vocabulary)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            rows = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = tokens.ids(text) + END.to_bytes(4, "little")
                for k, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append(row)
                    for column, value in zip(out, (k, start, n, zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(out, kinds))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets fixed by dominance, as (lengths, how many times), and the counts left.

    For the longest length j: nothing fits beside it -> alone.  One more at most,
    or a partner that fills it exactly -> with the largest partner i.  Two more at
    most -> with i if i is at least as large as the best pair (a, b), or with
    (a, b) if a = i and no two lengths between can take b's place together.
    Lengths that no rule settles are left.
    """
    left = {k: v for k, v in counts.items() if v}
    keys = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def smallest(n: int, but: int) -> list[int]:
        out: list[int] = []
        for k in keys:
            out += [k] * min(n - len(out), left[k] - (k == but))
            if len(out) == n:
                break
        return out

    def largest(room: int, *used: int) -> int | None:
        for at in range(bisect_right(keys, room) - 1, -1, -1):
            if left[keys[at]] > used.count(keys[at]):
                return keys[at]
        return None

    def take(group: tuple[int, ...]) -> None:
        times = min(left[k] // group.count(k) for k in set(group))
        fixed.append((group, times))
        for k in group:
            left[k] -= times
        for k in set(group):
            if not left[k]:
                del left[k]
                keys.pop(bisect_left(keys, k))

    top = capacity + 1
    while True:
        at = bisect_left(keys, top) - 1
        if at < 0:
            break
        j = keys[at]
        room = capacity - j
        least = smallest(3, j)
        fit = 0
        while fit < len(least) and sum(least[: fit + 1]) <= room:
            fit += 1
        if fit == 0:
            take((j,))
            continue
        partner = largest(room, j)
        if fit == 1 or partner == room:
            take((j, partner))
            continue
        if fit == 2:
            pair = best_pair(keys, left, room, j)
            if pair is None or partner >= sum(pair):
                take((j, partner))
                continue
            a, b = pair
            if a == partner and no_pair_between(keys, left, room, a, b, j):
                take((j, a, b))
                continue
        top = j
    return fixed, left


def best_pair(keys: list[int], left: dict[int, int], room: int, j: int) -> tuple[int, int] | None:
    """The pair beside ``j`` with the largest sum within ``room``, larger length first."""
    free = [k for k in keys[: bisect_right(keys, room)] if left[k] > (k == j)]
    best = None
    lo, hi = 0, len(free) - 1
    while lo <= hi:
        a, b = free[hi], free[lo]
        if a + b > room:
            hi -= 1
            continue
        enough = a != b or left[a] - (a == j) >= 2
        if enough and (best is None or a + b > sum(best)):
            best = (a, b)
        lo += 1
    return best


def no_pair_between(keys: list[int], left: dict[int, int], room: int, a: int, b: int, j: int) -> bool:
    """Whether no two lengths, both longer than ``b``, fit into ``room`` together."""
    two: list[int] = []
    for k in keys[bisect_right(keys, b) :]:
        two += [k] * min(2 - len(two), left[k] - (k == j))
        if len(two) == 2:
            return sum(two) > room
    return True


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over a histogram: (lengths in order of placing, how many sequences)."""
    done: list[tuple[tuple[int, ...], int]] = []
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    order: list[int] = []
    shortest = min(counts, default=0)

    def put(room: int, contents: tuple[int, ...], times: int) -> None:
        if room < shortest:
            done.append((contents, times))
            return
        if room not in rooms:
            rooms[room] = []
            order.insert(bisect_left(order, room), room)
        rooms[room].append((contents, times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(order, size)
            if at == len(order):
                each = capacity // size
                whole, rest = divmod(n, each)
                if whole:
                    put(capacity - each * size, (size,) * each, whole)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = order[at]
            contents, times = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = room // size
            whole = min(times, n // each)
            n -= whole * each
            if whole:
                put(room - each * size, contents + (size,) * each, whole)
            if whole < times:
                if n:
                    put(room - n * size, contents + (size,) * n, 1)
                    whole, n = whole + 1, 0
                if whole < times:
                    put(room, contents, times - whole)
    for room, classes in rooms.items():
        done += classes
    return done


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """All sequences as (lengths, multiplicity): those fixed by dominance, then best-fit."""
    fixed, left = reduce_instance(counts, capacity)
    return fixed + best_fit(left, capacity)


def places(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence base, copies a sequence, offset), sorted by length and rank."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for contents, times in plan:
        at = 0
        runs: list[list[int]] = []
        for size in contents:
            if runs and runs[-1][0] == size:
                runs[-1][1] += 1
            else:
                runs.append([size, 1, at])
            at += size
        for size, each, offset in runs:
            rank = used.get(size, 0)
            rows.append((size, rank, base, each, offset))
            used[size] = rank + each * times
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def ranked(parts: DataFrame) -> DataFrame:
    """``parts`` with ``rank``, from 0 without gaps within each length."""
    salts = parallelism(parts.sparkSession)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    totals = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = totals.select(
        "length",
        "salt",
        (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"),
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return (
        salted.withColumn("own", F.row_number().over(own) - 1)
        .join(before, ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("own"))
        .drop("salt", "own", "before")
    )


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset."""
    spark = parts.sparkSession
    parts = materialize(parts, "packing-pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(solve(counts, capacity)))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            at = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank")}
            row = plan[np.searchsorted(keys, (at["length"] << 44) + at["rank"], "right") - 1]
            copy, slot = np.divmod(at["rank"] - row[:, 1], row[:, 3])
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(row[:, 2] + copy), pa.array(row[:, 4] + slot * at["length"])],
                names=[*names, "sequence_id", "offset"],
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(parts).mapInArrow(seat, schema)


def default_vocabulary() -> Vocabulary:
    """The installed byte-level vocabulary of 50k."""
    import public_tokenizers as installed

    return Vocabulary(installed.path("byte_bpe_50k.json"), installed.path("byte_bpe_50k.tiktoken"), installed.PATTERN)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: Vocabulary | None = None) -> DataFrame:
    """Tokenise and pack every row of ``docs``."""
    return pack(pieces(docs, vocabulary or default_vocabulary(), capacity), capacity)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    return pack_documents(table(spark, sf_dir, "documents"))
