"""Removal of repeated byte strings with suffix arrays in shards.

Every byte covered by a string of ``length`` bytes that also starts elsewhere in
the corpus goes.  Shards are filled by content, so that a string is compared with
those it can equal and not with all: among the 32-byte pieces of a window (a
string of ``length`` bytes) the leftmost of least hash is its anchor, which
depends on the window alone.  Neighbouring windows with one anchor form a run, so
the windows of a text fall into runs, and equal windows always have equal anchors.

1.  Each task cuts its texts into runs and names each by the hash of its anchor
    and a 128-bit digest of its bytes.  Runs of equal bytes in a task travel as
    one row with all its places.  Runs whose anchor is met once cannot repeat.
2.  Every different run of the other anchors goes to a shard by the hash of its
    anchor, with the number of times its bytes were met.  A shard builds its
    suffix array, in which a suffix counts so many times, takes common prefixes of
    neighbours, and so finds all windows of its runs that start elsewhere.
3.  No shard takes more than ``shard_runs`` runs of one anchor; the runs of a
    more frequent anchor are dealt over several.  Each of those reports the
    digests of its windows, sorted, in ranges; every window that a shard found
    single is searched for in the ranges of the others, by binary search.
4.  Repeated starts go back to all places of a run and come together by text,
    which is cut and measured.

Joins on an anchor or a run that very many rows share are salted.  What is held
of a text beside its bytes (its runs, its cuts) is a fixed share of its length.

Strings are judged on the input, overlaps count, matches never cross texts.
Defined cases: a null text counts as empty; a text shorter than ``length`` loses
nothing; a row that repeats another whole row counts as another text; texts may
be of any length (they are cut into overlapping parts); an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import hot_keys, materialize, parallelism, small_batches, spread_join, table, text_or_empty
from glossmill.llm.hashing import mix
from glossmill.llm.suffix import repeated_starts

LENGTH, PIECE = 400, 32
#: Bytes of text a task works on at once, and of a shard's suffix array.
PART_BYTES, SHARD_BYTES = 1 << 20, 1 << 20
#: Most runs of one anchor in a shard, and shards of one anchor for each range of their merge.
SHARD_RUNS = 64
RANGE_SHARDS = 16
_BASE = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)
_NO_ID = -(1 << 63)


def _piece_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` bytes (a power of two)."""
    out, span, power = data.astype(np.uint64) + np.uint64(1), 1, _BASE
    while span < size:
        out = out[:-span] * np.uint64(power) + out[span:]
        power = power * power % (1 << 64)
        span *= 2
    return mix(out)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs_of(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(first start, number of windows, key) of the runs of texts that lie one after another.

    ``bounds`` has the place where each text starts, and the end.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    if len(data) < length:
        return none
    hashes = _piece_hashes(data, piece)
    places = np.arange(len(hashes), dtype=np.uint64)
    least = _sliding_least((hashes & ~_PLACE) | places, length - piece + 1)
    good = np.zeros(len(data) + 1, np.int32)
    sizes = np.diff(bounds)
    long = sizes >= length
    np.add.at(good, bounds[:-1][long], 1)
    np.add.at(good, bounds[1:][long] - length + 1, -1)
    starts = np.nonzero(np.cumsum(good)[: len(least)] > 0)[0]
    if not len(starts):
        return none
    anchors = (least[starts] & _PLACE).astype(np.int64)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = anchors[1:] != anchors[:-1]
    at = np.nonzero(fresh)[0]
    return starts[at], np.diff(np.concatenate((at, [len(starts)]))), hashes[anchors[at]]


_RUNS = "key long, digest binary, windows int, n int, places array<struct<doc_id:long,rid:long,start:long>>"


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """The different runs of each part of the texts, with all their places in it."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            for rows, lo, hi in _parts(offsets, length):
                yield from _run_rows(batch, raw[lo:hi], np.clip(offsets[rows[0] : rows[1] + 1], lo, hi) - lo, rows[0], lo - offsets[rows[0]], length)

    return docs.mapInArrow(run, _RUNS)


def _parts(offsets: np.ndarray, length: int) -> Iterator[tuple[tuple[int, int], int, int]]:
    """(row range, first byte, last byte) of parts to work on; a long text is cut with overlap."""
    row, n = 0, len(offsets) - 1
    while row < n:
        size = offsets[row + 1] - offsets[row]
        if size > PART_BYTES:
            for lo in range(offsets[row], max(offsets[row] + 1, offsets[row + 1] - length + 1), PART_BYTES):
                yield (row, row + 1), lo, min(lo + PART_BYTES + length - 1, offsets[row + 1])
            row += 1
            continue
        stop = int(np.searchsorted(offsets, offsets[row] + PART_BYTES, "right")) - 1
        stop = max(stop, row + 1)
        yield (row, stop), offsets[row], offsets[stop]
        row = stop


def _run_rows(batch, data: np.ndarray, bounds: np.ndarray, first_row: int, shift: int, length: int) -> Iterator[pa.RecordBatch]:
    starts, counts, keys = runs_of(data, bounds, length)
    if not len(starts):
        return
    view, digest = memoryview(data), xxhash.xxh3_128_digest
    stops = starts + counts + length - 1
    digests = [digest(view[a:b]) for a, b in zip(starts.tolist(), stops.tolist())]
    numbers: dict[bytes, int] = {}
    number = np.array([numbers.setdefault(d, len(numbers)) for d in digests])
    by = np.argsort(number, kind="stable")
    n = np.bincount(number)
    head = by[np.cumsum(n) - n]
    row = np.searchsorted(bounds, starts[by], "right") - 1
    take = pa.array(row + first_row, pa.int64())
    place = pa.array((starts[by] - bounds[row] + shift).astype(np.int64))
    places = pa.StructArray.from_arrays([batch.column(0).take(take), batch.column(1).take(take), place], ["doc_id", "rid", "start"])
    offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
    columns = [
        pa.array(keys[head].view(np.int64)),
        pa.array(list(numbers), pa.binary()),
        pa.array(counts[head].astype(np.int32)),
        pa.array(n.astype(np.int32)),
        pa.ListArray.from_arrays(offsets, places),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=["key", "digest", "windows", "n", "places"])


def _stretches(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First places and sizes of the stretches of true flags."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    return begin.tolist(), (end - begin).tolist()


_FOUND = "doc_id long, rid long, start long, windows int"
#: Places of windows in a shard's run, and where a run begins.
_MOST_WINDOWS = 1 << 16
_HEAD = np.dtype([("doc_id", "<i8"), ("rid", "<i8"), ("start", "<i8")])


def _window_digests(text: bytes, length: int) -> np.ndarray:
    """A 128-bit digest of each window, as rows of two numbers."""
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(text[i : i + length]) for i in range(len(text) - length + 1)])
    return np.frombuffer(raw, "<u8").reshape(-1, 2)


class _Columns:
    """Rows of one Arrow schema, gathered by column."""

    def __init__(self, **kinds: pa.DataType):
        self.kinds = kinds
        self.held: list[list] = [[] for _ in kinds]

    def put(self, *values) -> None:
        for column, value in zip(self.held, values):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        out = [pa.array(c, k) for c, k in zip(self.held, self.kinds.values())]
        self.held = [[] for _ in self.kinds]
        return pa.RecordBatch.from_arrays(out, names=list(self.kinds))


def _shards(contexts: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """Suffix arrays over runs dealt by (key, salt).

    Rows with ``range`` null tell repeated stretches of a run's windows: from the
    place ``start`` of its one text, or for a run met several times (doc_id null)
    by its digest.  The others hold, for an anchor of several shards, the sorted
    digests of windows of one range and the run and window each stands for (-1
    for one known to repeat), with the places of the runs.
    """
    schema = f"{_FOUND}, digest binary, key long, range int, digests binary, owners binary, heads binary"
    kinds = dict(doc_id=pa.int64(), rid=pa.int64(), start=pa.int64(), windows=pa.int32(), digest=pa.binary(), key=pa.int64())
    kinds |= dict(range=pa.int32(), digests=pa.binary(), owners=pa.binary(), heads=pa.binary())

    def solve(held: list[dict]) -> pa.RecordBatch:
        out = _Columns(**kinds)
        by_key: dict[int, list[tuple]] = {}
        for h, own in zip(held, repeated_starts([h["bytes"] for h in held], length, [h["n"] for h in held])):
            for begin, size in zip(*_stretches(own)):
                if h["n"] == 1:
                    out.put(h["doc_id"], h["rid"], h["start"] + begin, size, None, None, None, None, None, None)
                else:
                    out.put(None, None, begin, size, h["digest"], None, None, None, None, None)
            if h["parts"] > 1:
                by_key.setdefault(h["key"], []).append((h, own))
        for key, group in by_key.items():
            heads = np.array([(h["doc_id"], h["rid"], h["start"]) for h, _ in group], _HEAD)
            digests = np.concatenate([_window_digests(h["bytes"], length) for h, _ in group])
            places = [np.where(own, -1, i * _MOST_WINDOWS + np.arange(len(own))) for i, (_, own) in enumerate(group)]
            by = np.lexsort((digests[:, 1], digests[:, 0]))
            digests, owners = digests[by], np.concatenate(places)[by]
            fresh = np.ones(len(by), bool)
            fresh[1:] = (digests[1:] != digests[:-1]).any(axis=1)
            digests, owners = digests[fresh], owners[fresh]
            n_ranges = -(-group[0][0]["parts"] // RANGE_SHARDS)
            ranges = (digests[:, 0] >> np.uint64(40)).astype(np.int64) * n_ranges >> 24
            for r in np.unique(ranges).tolist():
                own = slice(*np.searchsorted(ranges, [r, r + 1]))
                # Of the runs only those that the range's windows stand for.
                known = owners[own] >= 0
                used, place = np.unique(owners[own][known] // _MOST_WINDOWS, return_inverse=True)
                stand = np.full(len(known), -1, "<i8")
                stand[known] = place * _MOST_WINDOWS + owners[own][known] % _MOST_WINDOWS
                out.put(None, None, None, None, None, key, r, digests[own].tobytes(), stand.tobytes(), heads[used].tobytes())
        return out.batch()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size, last, seen = 0, None, set()
        for batch in batches:
            for row in batch.to_pylist():
                group = (row["key"], row["salt"])
                if group != last:
                    if size >= shard_bytes:
                        yield solve(held)
                        held, size = [], 0
                    last, seen = group, set()
                if row["digest"] in seen:
                    continue
                seen.add(row["digest"])
                held.append(row)
                size += len(row["bytes"])
        if held:
            yield solve(held)

    return contexts.mapInArrow(run, schema)


def search(every: np.ndarray, own: np.ndarray) -> np.ndarray:
    """How often each of the digests ``own`` is among the sorted digests ``every``, by binary search."""
    fresh = np.ones(len(every), bool)
    fresh[1:] = (every[1:] != every[:-1]).any(axis=1)
    head = np.nonzero(fresh)[0]
    times = np.diff(np.concatenate((head, [len(every)])))
    different = every[head]
    at = np.searchsorted(different[:, 0], own[:, 0])
    stop = np.searchsorted(different[:, 0], own[:, 0], "right")
    while True:
        # Digests that agree in the first half only; next to never more than one step.
        wrong = (at < stop) & (different[np.minimum(at, len(different) - 1), 1] != own[:, 1])
        if not wrong.any():
            return np.where(at < stop, times[np.minimum(at, len(different) - 1)], 0)
        at = at + wrong


def _merge_ranges(reports: DataFrame) -> DataFrame:
    """Windows of anchors of several shards that another shard holds too."""

    def merge(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        shards = [(np.frombuffer(d, "<u8").reshape(-1, 2), np.frombuffer(o, "<i8"), np.frombuffer(h, _HEAD)) for d, o, h in held]
        every = np.concatenate([d for d, _, _ in shards])
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        found = []
        for digests, owners, heads in shards:
            single = owners >= 0
            again = np.sort(owners[single][search(every, digests[single]) > 1])
            fresh = np.ones(len(again), bool)
            fresh[1:] = again[1:] != again[:-1] + 1
            at = np.nonzero(fresh)[0]
            head = heads[again[at] // _MOST_WINDOWS]
            size = np.diff(np.concatenate((at, [len(again)])))
            found.append((head["doc_id"], head["rid"], head["start"] + again[at] % _MOST_WINDOWS, size.astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(np.concatenate(c))) for c in zip(*found)], names=["doc_id", "rid", "start", "windows"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for key, r, *report in zip(*(batch.column(n).to_pylist() for n in ("key", "range", "digests", "owners", "heads"))):
                if (key, r) != last and held:
                    yield merge(held)
                    held = []
                last = (key, r)
                held.append(report)
        if held:
            yield merge(held)

    dealt = reports.repartition(parallelism(reports.sparkSession), "key", "range").sortWithinPartitions("key", "range")
    return dealt.mapInArrow(run, _FOUND)


def _extract(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted runs (column ``runs``) of every text."""
    small_batches(texts.sparkSession)
    kinds = dict(doc_id=pa.int64(), rid=pa.int64(), key=pa.int64(), digest=pa.binary(), n=pa.int32(), parts=pa.int32())
    kinds |= dict(start=pa.int64(), bytes=pa.binary(), salt=pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Columns(**kinds)
            for doc_id, rid, text, wants in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "rid", "text", "runs"))):
                data = text.encode()
                for w in wants:
                    part = data[w["start"] : w["start"] + w["windows"] + length - 1]
                    salt = int.from_bytes(w["digest"][:4], "little") % w["parts"]
                    out.put(doc_id, rid, w["key"], w["digest"], w["n"], w["parts"], w["start"], part, salt)
            yield out.batch()

    return texts.mapInArrow(run, "doc_id long, rid long, key long, digest binary, n int, parts int, start long, bytes binary, salt int")


def repeated(docs: DataFrame, length: int = LENGTH, shard_runs: int = SHARD_RUNS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, rid, start, windows): all stretches of starts whose ``length`` bytes also start elsewhere.

    ``docs`` has doc_id, rid and text; doc_id and rid together name a text.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "rid", "text")
    runs = materialize(_cut(texts, length), "dedup-runs")
    keys = runs.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows")).where("total > 1")
    keys = materialize(keys, "dedup-keys")
    shared = materialize(
        spread_join(runs, keys.select("key"), "key", hot_keys(keys, "key", "rows"), ["digest"], "left_semi"), "dedup-shared"
    )
    kinds = shared.groupBy("key", "digest").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min(F.element_at("places", 1)).alias("rep"), F.first("windows").alias("windows")
    )
    kinds = materialize(kinds, "dedup-kinds")
    many = materialize(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > shard_runs), "dedup-many")
    parts = many.select("key", F.ceil(F.col("kinds") / F.lit(shard_runs)).cast("int").alias("parts"))
    dealt = spread_join(kinds, parts, "key", hot_keys(many, "key", "kinds"), ["digest"], "left")
    wanted = dealt.select(
        "rep.*",
        F.struct(
            "key",
            "digest",
            F.least("n", F.lit(2)).cast("int").alias("n"),
            F.coalesce("parts", F.lit(1)).alias("parts"),
            F.col("rep.start").alias("start"),
            "windows",
        ).alias("run"),
    )
    wanted = wanted.groupBy("doc_id", "rid").agg(F.collect_list("run").alias("runs"))
    contexts = _extract(texts.join(wanted, ["doc_id", "rid"]).select("doc_id", "rid", "text", "runs"), length)
    contexts = contexts.repartition(parallelism(spark), "key", "salt").sortWithinPartitions("key", "salt")
    shards = materialize(_shards(contexts, length, shard_bytes), "dedup-shards")
    columns = ("doc_id", "rid", "start", "windows")
    single = shards.where("range is null and digest is null").select(*columns)
    whole = shards.where("digest is not null").select("digest", F.col("start").alias("begin"), F.col("windows").alias("size"))
    copies = kinds.where("n > 1")
    met = spread_join(shared.select("digest", "places"), whole, "digest", hot_keys(copies, "digest", "rows"), ["places"], "inner")
    places = met.select(F.explode("places").alias("p"), "begin", "size")
    copied = places.select("p.doc_id", "p.rid", (F.col("p.start") + F.col("begin")).alias("start"), F.col("size").alias("windows"))
    return single.unionByName(copied).unionByName(_merge_ranges(shards.where("range is not null")))


def _with_rid(docs: DataFrame) -> DataFrame:
    """doc_id (a stand-in where null), rid and text; rid is a hash of the text."""
    text, doc_id = text_or_empty(), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(text).alias("rid"), text.alias("text"))


def _with_cuts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with ``cuts``: stretches of repeated starts of each text, or null."""
    by_text = found.groupBy("doc_id", "rid").agg(F.collect_list(F.struct("start", "windows")).alias("cuts"))
    return docs.join(by_text, ["doc_id", "rid"], "left").select("doc_id", "rid", "text", "cuts")


def kept_bytes(data: bytes, cuts: list[dict] | None, length: int = LENGTH) -> tuple[bytes, int]:
    """What is left of a text, and how many maximal runs were removed."""
    if not cuts:
        return data, 0
    gone = np.zeros(len(data) + 1, np.int32)
    for c in cuts:
        gone[c["start"]] += 1
        gone[c["start"] + c["windows"] + length - 1] -= 1
    mask = np.cumsum(gone)[:-1] > 0
    spans = int(np.count_nonzero(mask[1:] & ~mask[:-1])) + int(mask[:1].any())
    return np.frombuffer(data, np.uint8)[~mask].tobytes(), spans


def deduplicate(docs: DataFrame, length: int = LENGTH, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` is the rest of its text as bytes."""
    rows = _with_rid(docs)
    cut = _with_cuts(rows, repeated(rows, length, shard_runs))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, spans, kept = [], [], [], []
            for text, cuts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = text.encode()
                rest, runs = kept_bytes(data, cuts, length)
                n.append(len(data))
                gone.append(len(data) - len(rest))
                spans.append(runs)
                kept.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    out = cut.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table, then whether and what of a text is left.

    ``text`` has what is left; a character that was cut apart shows as U+FFFD.
    """
    found = deduplicate(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("removed"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def brute_force(texts: list[str], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text by counting all strings; for tests."""
    counts: dict[bytes, int] = {}
    datas = [t.encode() for t in texts]
    for data in datas:
        for i in range(len(data) - length + 1):
            counts[data[i : i + length]] = counts.get(data[i : i + length], 0) + 1
    out = []
    for data in datas:
        cuts = [{"start": i, "windows": 1} for i in range(len(data) - length + 1) if counts[data[i : i + length]] > 1]
        rest, spans = kept_bytes(data, cuts, length)
        out.append((len(data), len(data) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out
