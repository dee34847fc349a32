"""Document fingerprints by one-permutation MinHash.

Each five-word shingle is hashed once; the high bits choose one of ``bins`` bins
and the least hash of a bin stays.  An empty bin takes the value of a full bin
that a fixed random walk from it meets first (optimal densification), so bins of
two texts agree as often as their shingle sets are alike.  Values are scrambled
with the number of their bin, so that copies of one value are as independent as
different values, and of every bin only the low ``bits`` bits are kept, packed.
Likeness is the share of equal bins, with the share by which low bits agree by
chance taken off.

Fingerprints are fixed-size strings of a text alone: equal texts have equal ones.

``with_next`` finds for every row the row that follows it in descending doc_id.
Rows are dealt by range into buckets, as many as the size of the table asks for,
whose bounds come from a quantile sketch of doc_id; the first row of each bucket
is copied to the bucket before it, so one shuffle of the texts brings all
neighbours together and no task sees the whole.  A task holds two texts at a time.

Defined cases: a null text counts as empty; a text of fewer words is one shingle;
a text without words has an empty fingerprint (all zeros), of likeness 1 to
another such and 0 to others; rows of equal doc_id follow each other in order of
their texts; rows without doc_id come last; a single row is its own next; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import parallelism, small_batches, table, text_or_empty
from glossmill.llm.hashing import mix, shingle_hashes, word_hashes

SHINGLE, BINS, BITS = 5, 512, 4
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Steps of the walks that a sketcher keeps at hand.
_TABLED = 340


class Sketcher:
    """Fingerprints of texts for one number of bins and kept bits."""

    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE):
        if bins & (bins - 1) or 8 % bits:
            raise ValueError("bins must be a power of two and bits divide 8")
        self.bins, self.bits, self.shingle = bins, bits, shingle
        self.shift = np.uint64(64 - bins.bit_length() + 1)
        self.marks = mix(np.arange(1, bins + 1, dtype=np.uint64))
        self.table = self._walks(np.arange(1, _TABLED + 1), np.arange(bins)).astype(np.int16 if bins < 1 << 15 else np.int64)

    def _walks(self, steps: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """The bins that walks from ``bins`` reach at ``steps`` (rows)."""
        seeds = bins.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + steps.astype(np.uint64)[:, None]
        return (mix(seeds) >> self.shift).astype(np.int64)

    def _densify(self, least: np.ndarray) -> np.ndarray:
        full = least != _EMPTY
        empty = np.nonzero(~full)[0]
        known = np.nonzero(full)[0]
        if len(known) == 1:
            least[:] = least[known[0]]
            return least
        at, chunk = 0, 4
        while len(empty):
            stop = at + chunk
            inside = stop <= len(self.table)
            to = self.table[at:stop, empty] if inside else self._walks(np.arange(at + 1, stop + 1), empty)
            good = full[to]
            first = good.argmax(axis=0)
            column = np.arange(len(empty))
            met = good[first, column]
            least[empty[met]] = least[to[first[met], column[met]]]
            empty = empty[~met]
            at, chunk = stop, min(chunk * 4, 256)
        return least

    def sketch(self, words: np.ndarray) -> bytes:
        """The packed fingerprint of a sequence of word hashes."""
        if not len(words):
            return b""
        hashes = shingle_hashes(words, self.shingle)
        order = np.unique(hashes)
        bins = (order >> self.shift).astype(np.int64)
        least = np.full(self.bins, _EMPTY)
        first = np.concatenate(([0], np.nonzero(np.diff(bins))[0] + 1))
        least[bins[first]] = order[first]
        low = (mix(self._densify(least) ^ self.marks) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        per = 8 // self.bits
        packed = np.zeros(self.bins // per, np.uint8)
        for i in range(per):
            packed |= low[i::per] << np.uint8(self.bits * i)
        return packed.tobytes()

    def of_text(self, text: str) -> bytes:
        return self.sketch(word_hashes(text))

    def likeness(self, a: bytes, b: bytes) -> float:
        """The estimated share of common shingles, 0 to 1."""
        if not a or not b:
            return float(a == b)
        if a == b:
            return 1.0
        x = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
        mask = np.uint8((1 << self.bits) - 1)
        same = sum(int(np.count_nonzero((x >> np.uint8(self.bits * i) & mask) == 0)) for i in range(8 // self.bits))
        chance = 2.0**-self.bits
        return min(1.0, max(0.0, (same / self.bins - chance) / (1 - chance)))

    def text_form(self, packed: bytes) -> str:
        """The fingerprint as a string of hexadecimal digits."""
        return packed.hex() if packed else "00" * (self.bins * self.bits // 8)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points from the head of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half] if half else text


#: Bytes of the table's files that a bucket stands for, and bounds in a group.
BUCKET_BYTES = 64 << 20
_GROUP = 256


def buckets_of(docs: DataFrame) -> int:
    """How many buckets the size of a table asks for, by the planner's estimate."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # An estimate of tables of unknown size is next to endless; a bucket of them is a task.
    known = size if size < 1 << 60 else 0
    return min(max(4 * parallelism(docs.sparkSession), known // BUCKET_BYTES), _GROUP * _GROUP)


def bucket_of(value, cuts: list[int]):
    """How many of ``cuts``, in order, are below a column: first among every so-manieth, then in its group."""
    groups = [cuts[i : i + _GROUP] for i in range(0, len(cuts), _GROUP)]
    listed = F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups])
    group = F.size(F.filter(F.array(*[F.lit(g[-1]) for g in groups]), lambda c: c < value))
    own = F.when(group < len(groups), F.size(F.filter(listed[F.least(group, F.lit(len(groups) - 1))], lambda c: c < value)))
    return group * _GROUP + F.coalesce(own, F.lit(len(cuts) - _GROUP * len(groups)))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, guest, doc_id, text), sorted in each task so that a row's next follows it.

    A guest is a copy of the first row of the bucket that comes after.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    count = buckets_of(docs)
    known = rows.select("doc_id").where("doc_id is not null")
    cuts = sorted({int(x) for x in known.approxQuantile("doc_id", [i / count for i in range(1, count)], 0.25 / count)})
    bucket = F.lit(len(cuts) + 1)
    if cuts:
        below = bucket_of(F.col("doc_id"), cuts)
        bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - below)
    dealt = rows.withColumn("bucket", bucket)
    heads = {
        r["bucket"]: r["head"]
        for r in rows.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()
    }
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    host_map = spark.createDataFrame([(b, heads[b], before[b]) for b in order], "bucket int, head long, host int")
    guests = (
        dealt.join(F.broadcast(host_map), (dealt["bucket"] == host_map["bucket"]) & dealt["doc_id"].eqNullSafe(host_map["head"]))
        .groupBy(host_map["host"].alias("bucket"), "doc_id")
        .agg(F.min("text").alias("text"))
        .select("bucket", F.lit(True).alias("guest"), "doc_id", "text")
    )
    own = dealt.select("bucket", F.lit(False).alias("guest"), "doc_id", "text")
    return (
        own.unionByName(guests)
        .repartition(max(parallelism(spark), count // 4), "bucket")
        .sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text")
    )


def fingerprint(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """For every row its fingerprint, that of its edited text, and likenesses."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(bins, bits)
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None
        for batch in batches:
            out: list[list] = [[] for _ in names]
            columns = (c.to_pylist() for c in batch.columns)
            for bucket, guest, doc_id, text in zip(*columns):
                if held and held[0] == bucket:
                    _, last_id, last, mark = held
                    new = edited(last, text)
                    changed = maker.of_text(new)
                    following = maker.of_text(text)
                    values = (
                        last_id,
                        len(last),
                        hashlib.sha256(new.encode()).hexdigest(),
                        maker.text_form(mark),
                        maker.text_form(changed),
                        maker.likeness(mark, changed),
                        maker.likeness(mark, following),
                    )
                    for column, value in zip(out, values):
                        column.append(value)
                    held = None if guest else (bucket, doc_id, text, following)
                elif not guest:
                    held = (bucket, doc_id, text, maker.of_text(text))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(run, schema)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    return fingerprint(table(spark, sf_dir, "documents"))
