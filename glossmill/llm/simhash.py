"""SimHash near-duplicates by anchor-point covering.

A document's fingerprint of 64 or 128 bits takes, bit by bit, the majority over
the hashes of its word shingles: XXH64 for 64 bits, XXH3 for 128.  Two
fingerprints link at ``threshold`` or fewer differing bits.

Links are found through anchors.  The bits are cut into blocks, 64 into three of
22, 21 and 21 bits, 128 into eight of 16.  Of ``threshold`` differing bits some
block has at most ``threshold // blocks``.  In each block the anchors are the code
words of the perfect binary Golay code of length 23 (shorter blocks are padded
with zeros), whose covering radius is 3: every block value has exactly one anchor
within 3 bits, its home.  A fingerprint is copied to every anchor within 3 bits
and that share of the threshold that can be the home of a linked one, so of any
linked pair one meets the other at the other's home, in at least one block.
Anchors compare homes with all that came to them on whole fingerprints and return
only a spanning forest, never all pairs; components are then joined over the
whole table.

Exact copies collapse to one fingerprint before anything is copied, so a group
of copies costs one row per anchor however large it is.

The 64-bit form at 4 bits is for fingerprints that others compute too.  For
``keep_one`` 4 of 64 bits would find few texts of likeness 0.8: a likeness J of
shingle sets is an angle of about arccos(2J / (1 + J)), 0.15 of all bits at 0.8,
which is 19 of 128 with a deviation of 4.  It therefore takes 128 bits of the set
of five-word shingles and links at 32 bits, three deviations above.  Copies go to
the anchors of values within 1 bit of a block, some 42 for a fingerprint.  That
meets all pairs within 15 bits and of the others those of which one is within 1
bit of a value with the other's anchor in some block: with 19 differing bits, 999
of 1,000.  These links only name candidates: an edge is a pair whose shingle sets
have a Jaccard likeness of 0.8 or more, counted in full.

Candidates are counted pair by pair, in rounds, and no task holds a group.  A text
asks for the first two of its linked texts that follow a place of its own on the
circle of names, so that no text is asked for by many, and all anchors agree on
whom it asks for.  Pairs found alike join components; a next round runs over the
texts that have more links to other components, with four times as many pairs
each.  There a link also has to pass a bound: shingles are dealt into 2,048 buckets,
and buckets in which two sets differ by an odd number are no more than their
shingles that differ.  Only pairs that the bound shows to be below the likeness
are passed over.  A group of thousands that are all alike is joined by some two
pairs a text, and one whose links fail is mostly settled by the bound.  The rounds
end when no text has a link to another component that was not counted or bound.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and links like any other; fewer words than a shingle form one
shingle of all of them; repeated rows share their component; a component is
named by its smallest non-null doc_id; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import materialize, parallelism, small_batches, text_or_empty
from glossmill.llm.components import connected_components
from glossmill.llm.hashing import mix, shingle_hashes, word_hashes

#: Seed of XXH64.
SEED = 42
#: Bits of the blocks of each word, from the low end, by words of 64 bits.
BLOCKS = {1: ((22, 21, 21),), 2: ((16, 16, 16, 16), (16, 16, 16, 16))}
#: Bits of 128 that differ at most between candidates of ``keep_one``, and bits of a block by which their anchors are found.
NEAR_BITS = 32
NEAR_REACH = 1
#: Pairs that a text asks for in the first round, and by how much they grow in each further one.
FIRST_PAIRS, MORE_PAIRS = 2, 4
#: Likeness of texts of which ``keep_one`` keeps one, as a fraction.
LIKE = (4, 5)
#: Generator polynomial of the binary Golay code of length 23.
GOLAY = 0b110001110101
_CHUNK = 1 << 15
#: Pairs of fingerprints that are compared at once.
_COMPARED = 1 << 20
#: Buckets whose parity bounds a likeness, and pairs that are bound at once.
_BUCKETS, _BOUND = 2048, 1 << 14
#: Bits of the map that picks texts to read again.
_SLOTS = 1 << 26


def word_fingerprint(text: str | None, words_per_shingle: int = 4, size: int = 1) -> bytes:
    """The bytes, high byte first, of a text's fingerprint of ``size`` words of 64 bits."""
    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8 * size)
    joined, n = b" ".join(words), len(words)
    width = min(words_per_shingle, n)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    total = np.zeros(64 * size, np.int64)
    digest = xxhash.xxh64_digest if size == 1 else xxhash.xxh3_128_digest
    for i in range(0, len(starts), _CHUNK):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK], stops[i : i + _CHUNK])])
        total += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8 * size), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(starts)).tobytes()


def _prints(size: int) -> list[str]:
    return [f"f{i}" for i in range(size)]


def fingerprints(docs: DataFrame, words_per_shingle: int = 4, size: int = 1) -> DataFrame:
    """(doc_id, f0, ..) for every row; the fingerprint as ``size`` signed longs."""
    small_batches(docs.sparkSession)
    names = ["doc_id", *_prints(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join(word_fingerprint(t, words_per_shingle, size) for t in batch.column(1).to_pylist())
            fps = np.frombuffer(raw, ">i8").astype(np.int64).reshape(-1, size)
            columns = [pa.array(np.ascontiguousarray(fps[:, i])) for i in range(size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return source.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def shingle_set(text: str, words_per_shingle: int) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    return np.unique(shingle_hashes(word_hashes(text), words_per_shingle))


def set_fingerprint(shingles: np.ndarray, size: int) -> bytes:
    """The bytes, high byte first, of the fingerprint of a shingle set; each shingle counts once."""
    total = np.zeros(64 * size, np.int64)
    for i in range(0, len(shingles), _CHUNK):
        part = shingles[i : i + _CHUNK]
        raw = np.stack([mix(part ^ np.uint64(SEED + k)) for k in range(size)], axis=1).astype(">u8")
        total += np.unpackbits(raw.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(total * 2 > len(shingles)).tobytes()


def set_node(shingles: np.ndarray) -> int:
    """A name of a shingle set, a signed long."""
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes(), SEED), "big", signed=True)


def print_nodes(fps: np.ndarray) -> np.ndarray:
    """Names of fingerprints (rows of words), signed longs."""
    out = np.zeros(len(fps), np.uint64)
    for k in range(fps.shape[1]):
        out = mix(out ^ np.ascontiguousarray(fps[:, k]).view(np.uint64))
    return out.view(np.int64)


def _text_key():
    return F.xxhash64(text_or_empty())


def set_prints(docs: DataFrame, words_per_shingle: int, size: int) -> DataFrame:
    """(doc_id, key, node, f0, ..) for every row: a key of its text, a name of its shingle set and its fingerprint."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "key", "node", *_prints(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, raw = [], []
            for text in batch.column(2).to_pylist():
                own = shingle_set(text, words_per_shingle)
                nodes.append(set_node(own))
                raw.append(set_fingerprint(own, size))
            fps = np.frombuffer(b"".join(raw), ">i8").astype(np.int64).reshape(-1, size)
            columns = [pa.array(nodes, pa.int64())]
            columns += [pa.array(np.ascontiguousarray(fps[:, i])) for i in range(size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=names)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_key().alias("key"), text_or_empty().alias("text"))
    return source.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and the error word of each remainder."""

    def remainder(v: int) -> int:
        for i in range(22, 10, -1):
            if v >> i & 1:
                v ^= GOLAY << (i - 11)
        return v

    unit = [remainder(1 << i) for i in range(23)]

    def spread(bits: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int32)
        for r in bits:
            out = np.concatenate((out, out ^ r))
        return out

    errors = np.zeros(2048, np.int32)
    for weight in (1, 2, 3):
        for places in itertools.combinations(range(23), weight):
            syndrome = 0
            for p in places:
                syndrome ^= unit[p]
            errors[syndrome] = sum(1 << p for p in places)
    return spread(unit[:12]), spread(unit[12:]), errors


class Anchors:
    """Homes and reachable anchors of fingerprints, for one threshold and size.

    ``reach`` takes the place of the bits by which the blocks of a linked pair differ.
    """

    def __init__(self, threshold: int, size: int = 1, reach: int | None = None):
        self.low, self.high, self.errors = _golay_tables()
        self.blocks = BLOCKS[size]
        near = threshold // sum(map(len, self.blocks)) if reach is None else reach
        self.flips = {}
        for bits in {b for word in self.blocks for b in word}:
            words = [sum(1 << p for p in c) for w in range(near + 1) for c in itertools.combinations(range(bits), w)]
            self.flips[bits] = np.array(words, np.int32)

    def anchor(self, block: np.ndarray) -> np.ndarray:
        syndrome = self.low[block & 0xFFF] ^ self.high[block >> 12]
        return (block ^ self.errors[syndrome]) >> 11

    def replicas(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each block of fingerprints (rows of words): keys, row numbers, whether the anchor is the home."""
        b = -1
        for word, blocks in enumerate(self.blocks):
            rest = np.ascontiguousarray(fps[:, word]).view(np.uint64)
            for bits in blocks:
                b += 1
                block = (rest & np.uint64((1 << bits) - 1)).astype(np.int32)
                rest = rest >> np.uint64(bits)
                home = self.anchor(block)
                cells = np.sort(self.anchor(block[:, None] ^ self.flips[bits][None, :]), axis=1)
                fresh = np.ones(cells.shape, bool)
                fresh[:, 1:] = cells[:, 1:] != cells[:, :-1]
                rows, cols = np.nonzero(fresh)
                keys = cells[rows, cols]
                yield (keys + (b << 12)).astype(np.int32), rows, keys == home[rows]


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def forest(nodes: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of nodes that join all linked fingerprints met at one anchor.

    Homes are taken in tiles that grow; pairs already joined are skipped, so a
    dense group costs comparisons but no list of pairs.
    """
    n, homes = len(fps), np.nonzero(home)[0]
    parent = np.arange(n)
    words = [np.ascontiguousarray(fps[:, i]).view(np.uint64) for i in range(fps.shape[1])]
    at, tile = 0, 1
    most = max(1, (1 << 22) // max(1, n))
    while at < len(homes):
        rows = homes[at : at + tile]
        at, tile = at + tile, min(tile * 2, most)
        apart = np.bitwise_count(words[0][rows][:, None] ^ words[0][None, :])
        for w in words[1:]:
            apart += np.bitwise_count(w[rows][:, None] ^ w[None, :])
        close = apart <= threshold
        close &= parent[rows][:, None] != parent[None, :]
        left, right = np.nonzero(close)
        for i, j in zip(rows[left].tolist(), right.tolist()):
            a, b = int(parent[i]), int(parent[j])
            while parent[a] != a:
                a = int(parent[a])
            while parent[b] != b:
                b = int(parent[b])
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(left):
            parent = _find(parent)
    members = np.nonzero(parent != np.arange(n))[0]
    return nodes[members], nodes[parent[members]]


def links(prints: DataFrame, threshold: int = 4, size: int = 1, reach: int | None = None) -> DataFrame:
    """Edges (a, b) between nodes whose components are those of all links.

    ``prints`` has a distinct long column ``node`` and the words f0, .. of its fingerprint;
    without that column, nodes are named by ``print_nodes`` and not sent along.
    With a smaller ``reach`` than the threshold's share of a block, links that meet at no anchor are not found.
    """
    spark = prints.sparkSession
    small_batches(spark)
    words = _prints(size)
    own = ["node"] if "node" in prints.columns else []
    names = ["anchor", *own, *words, "home"]

    def copy_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(threshold, size, reach)
        for batch in batches:
            sent = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for keys, rows, home in anchors.replicas(np.stack(sent[len(own) :], axis=1)):
                columns = [pa.array(keys), *(pa.array(f[rows]) for f in sent), pa.array(home)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[tuple]) -> pa.RecordBatch:
            nodes, fps, home = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(nodes)
            nodes, fps, home = nodes[order], fps[order], home[order]
            a, b = forest(nodes, fps, home, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held, key = [], None
        for batch in batches:
            keys, *sent, home = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fps = np.stack(sent[len(own) :], axis=1)
            nodes = sent[0] if own else print_nodes(fps)
            cuts = np.nonzero(np.diff(keys))[0] + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                if lo == hi:
                    continue
                if held and keys[lo] != key:
                    yield done(held)
                    held = []
                key = keys[lo]
                held.append((nodes[lo:hi], fps[lo:hi], home[lo:hi]))
        if held:
            yield done(held)

    kinds = ", ".join(f"{w} long" for w in [*own, *words])
    copies = prints.select(*own, *words).mapInArrow(copy_out, f"anchor int, {kinds}, home boolean")
    met = copies.repartition(parallelism(spark), "anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(compare, "a long, b long")


def components(docs: DataFrame, words_per_shingle: int = 4, threshold: int = 4, size: int = 1) -> DataFrame:
    """(doc_id, f0, .., component_id) for every row of ``docs``.

    A class of equal fingerprints is a node, named by its fingerprint or a digest of it.
    """
    words = _prints(size)
    prints = materialize(fingerprints(docs, words_per_shingle, size), "simhash-prints")
    node = F.col("f0") if size == 1 else F.xxhash64(*words)
    classes = prints.groupBy(*words).agg(F.min("doc_id").alias("least")).withColumn("node", node)
    classes = materialize(classes, "simhash-classes")
    stars = connected_components(links(classes, threshold, size), "simhash-stars")
    rooted = classes.join(stars, "node", "left").select(*words, "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = materialize(rooted.join(named, "root").select(*words, "component_id"), "simhash-named")
    return prints.join(by_print, words).select("doc_id", *words, "component_id")


def set_parity(shingles: np.ndarray) -> bytes:
    """A bit for each bucket of shingles: whether a set has an odd number there."""
    counts = np.bincount((shingles % np.uint64(_BUCKETS)).astype(np.int64), minlength=_BUCKETS)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def may_be_like(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, parity: np.ndarray) -> np.ndarray:
    """For pairs of places whether their sets can have a likeness of ``LIKE``, by their sizes and parities (rows of words)."""
    up, down = LIKE
    out = np.zeros(len(left), bool)
    for i in range(0, len(left), _BOUND):
        a, b = left[i : i + _BOUND], right[i : i + _BOUND]
        apart = np.bitwise_count(parity[a] ^ parity[b]).sum(axis=1, dtype=np.int64)
        apart = np.maximum(apart, np.abs(sizes[a] - sizes[b]))
        both = sizes[a] + sizes[b]
        out[i : i + _BOUND] = (both - apart) * down >= (both + apart) * up
    return out


def first_linked(
    nodes: np.ndarray, fps: np.ndarray, roots: np.ndarray, home: np.ndarray, threshold: int, most: int,
    sizes: np.ndarray | None = None, parity: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each home among ``nodes`` (unsigned, in order) the first ``most`` links to nodes of another root.

    Links are taken round the circle of names from a place that the home's name
    gives; with sizes and parities of the sets, those that cannot be alike are no
    links.  Places (a, b) of the pairs, and for every node whether it has a link and
    whether it has more of them than were taken.
    """
    n = len(nodes)
    linked, more, pairs = np.zeros(n, bool), np.zeros(n, bool), []
    words = [np.ascontiguousarray(fps[:, i]).view(np.uint64) for i in range(fps.shape[1])]
    homes, step = np.nonzero(home)[0], max(1, _COMPARED // max(1, n))
    for at in range(0, len(homes), step):
        rows = homes[at : at + step]
        close = roots[rows][:, None] != roots[None, :]
        if not close.any():
            continue
        apart = np.bitwise_count(words[0][rows][:, None] ^ words[0][None, :])
        for w in words[1:]:
            apart += np.bitwise_count(w[rows][:, None] ^ w[None, :])
        close &= apart <= threshold
        left, right = np.nonzero(close)
        if parity is not None:
            able = may_be_like(rows[left], right, sizes, parity)
            left, right = left[able], right[able]
            if not len(left):
                continue
        linked[rows[left]] = linked[right] = True
        count = np.bincount(left, minlength=len(rows))
        more[rows] = count > most
        before = right < np.searchsorted(nodes, mix(nodes[rows]))[left]
        skipped = np.bincount(left[before], minlength=len(rows))
        place = np.arange(len(left)) - (np.cumsum(count) - count)[left]
        taken = (place - skipped[left]) % count[left] < most
        pairs.append((rows[left[taken]], right[taken]))
    a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    return a, b, linked, more


def neighbours(live: DataFrame, threshold: int, size: int, reach: int, most: int) -> DataFrame:
    """(a, b, far, more): pairs that the nodes of ``live`` ask for, and every linked node as ``a`` without a ``b``.

    ``live`` has node, root, open, the words of the fingerprint, size and parity (empty where not known).  Open nodes ask at
    each of their homes for their first ``most`` links to nodes of another root;
    ``far`` orders them, ``more`` tells that a home had more of them.
    """
    spark = live.sparkSession
    small_batches(spark)
    words = _prints(size)
    sent = ["node", "root", *words, "size"]
    names = ["anchor", *sent, "home", "parity"]

    def copy_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(threshold, size, reach)
        for batch in batches:
            *own, asks = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1])
            for keys, rows, home in anchors.replicas(np.stack(own[2:-1], axis=1)):
                columns = [pa.array(keys), *(pa.array(f[rows]) for f in own), pa.array(home & asks[rows])]
                columns.append(batch.columns[-1].take(pa.array(rows)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def ask(parts: list[tuple]) -> pa.RecordBatch:
        nodes, roots, *fps, sizes, home = (np.concatenate(x) for x in zip(*(p for p, _ in parts)))
        raw = b"".join(x for _, p in parts for x in p.to_pylist())
        parity = np.frombuffer(raw, np.uint64).reshape(len(nodes), -1) if raw else None
        nodes = nodes.view(np.uint64)
        order = np.argsort(nodes)
        nodes, fps = nodes[order], np.stack(fps, axis=1)[order]
        parity = None if parity is None else parity[order]
        a, b, linked, more = first_linked(nodes, fps, roots[order], home[order], threshold, most, sizes[order], parity)
        far = ((nodes[b] - mix(nodes[a])) >> np.uint64(1)).view(np.int64)
        named, held = nodes.view(np.int64), np.nonzero(linked)[0]
        none = pa.nulls(len(held), pa.int64())
        pairs = [pa.array(named[a]), pa.array(named[b]), pa.array(far), pa.array(np.zeros(len(a), bool))]
        alone = [pa.array(named[held]), none, none, pa.array(more[held])]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(pairs, alone)], names=["a", "b", "far", "more"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:-1])
            cuts = np.nonzero(np.diff(keys))[0] + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
                if lo == hi:
                    continue
                if held and keys[lo] != key:
                    yield ask(held)
                    held = []
                key = keys[lo]
                held.append(([c[lo:hi] for c in rest], batch.columns[-1].slice(lo, hi - lo)))
        if held:
            yield ask(held)

    kinds = ", ".join(f"{w} long" for w in sent)
    copies = live.select(*sent, "open", "parity").mapInArrow(copy_out, f"anchor int, {kinds}, home boolean, parity binary")
    met = copies.repartition(parallelism(spark), "anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(compare, "a long, b long, far long, more boolean")


def is_like(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sets (distinct values in order) have a Jaccard likeness of ``LIKE`` or more; empty ones have none."""
    if len(one) > len(two):
        one, two = two, one
    up, down = LIKE
    if not len(one) or len(one) * down < len(two) * up:
        return False
    shared = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
    return shared * down >= (len(one) + len(two) - shared) * up


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, like) for the pairs (a, b) of names in ``sets`` (node, shingles)."""
    small_batches(pairs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = [
                is_like(np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64))
                for one, two in zip(batch.column(2), batch.column(3))
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(like, pa.bool_())], names=["a", "b", "like"])

    # Merges at every size: sets grow with the table.
    sets = sets.select("node", "shingles")
    one = pairs.join(sets.toDF("a", "one").hint("merge"), "a")
    both = one.join(sets.toDF("b", "two").hint("merge"), "b")
    return both.select("a", "b", "one", "two").mapInArrow(count, "a long, b long, like boolean")


def bitmap_of(rows: DataFrame) -> bytes:
    """A bit for each value of the column ``slot``, 0 to ``_SLOTS`` - 1, nulls apart; of fixed size however many rows there are."""
    block = rows.where("slot is not null").select((F.col("slot") + 1).alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("n"))
    bits = bytearray(_SLOTS // 8)
    for row in block.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect():
        bits[(row["n"] - 1) * 4096 : row["n"] * 4096] = row["bits"]
    return bytes(bits)


def _slot(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(_SLOTS))


def without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """``docs``, with ``__doc`` and ``__key``, without the rows that ``drop`` names by these columns.

    A bitmap lets most rows that stay pass where they lie; only the others, those
    that go and a few more, are sent to be joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(drop.select(_slot("__doc", "__key").alias("slot"))))

    @F.pandas_udf("boolean")
    def named(slots: pd.Series) -> pd.Series:
        bits, at = np.frombuffer(shared.value, np.uint8), slots.to_numpy()
        return pd.Series(bits[at >> 3] >> (at & 7) & 1 == 1)

    marked = docs.withColumn("__named", F.col("__doc").isNotNull() & named(_slot("__doc", "__key")))
    stay = marked.where(~F.col("__named"))
    return stay.unionAll(marked.where("__named").join(drop, ["__doc", "__key"], "left_anti").select(*marked.columns)).drop("__named")


def member_sets(docs: DataFrame, members: DataFrame, words_per_shingle: int) -> DataFrame:
    """(node, shingles, size, parity) for the sets in ``members`` (node, doc_id of one text that has it).

    Texts are read again and never shuffled: a bitmap of fixed size passes those
    of the members, one of each set, and a few others that the join leaves out.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            slots = batch.column(0).to_numpy(zero_copy_only=False)
            rows = np.nonzero((slots < 0) | (wanted[slots >> 3] >> (slots & 7) & 1 == 1))[0]
            sets = {}
            for text in batch.column(1).take(pa.array(rows)):
                own = shingle_set(text.as_py(), words_per_shingle)
                sets[set_node(own)] = own.tobytes(), len(own), set_parity(own)
            raw, sizes, parity = zip(*sets.values()) if sets else ((), (), ())
            columns = [pa.array(list(sets), pa.int64()), pa.array(raw, pa.binary()), pa.array(sizes, pa.int64()), pa.array(parity, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "shingles", "size", "parity"])

    slot = _slot("doc_id")
    bits = bitmap_of(members.where("doc_id is not null").select(slot.alias("slot")))
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    texts = texts.select(F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(slot).alias("slot"), "text")
    sets = texts.mapInArrow(cut, "node long, shingles binary, size long, parity binary")
    return sets.join(members.select("node").hint("merge"), "node").dropDuplicates(["node"])


def like_components(docs: DataFrame, nodes: DataFrame, words_per_shingle: int, threshold: int, size: int) -> DataFrame:
    """(node, root) for the shingle sets in ``nodes`` (node, words, doc_id) that are alike with another.

    Edges are linked pairs of likeness ``LIKE``; they are counted in rounds until no
    open node has a link to another component that was not counted.
    """
    words, most = _prints(size), FIRST_PAIRS
    live = nodes.withColumn("root", F.col("node")).withColumn("open", F.lit(True))
    live = live.withColumn("size", F.lit(0).cast("long")).withColumn("parity", F.lit(b""))
    members = sets = checked = roots = None
    while True:
        found = materialize(neighbours(live, threshold, size, NEAR_REACH, most), "simhash-found")
        asked = found.where("b is not null").select("a", "b", "far").distinct()
        ranked = asked.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy("far", "b")))
        beyond = ranked.where(F.col("rank") == most + 1).select("a", F.lit(True).alias("more"))
        state = found.where("b is null").select("a", "more").unionByName(beyond)
        state = materialize(state.groupBy(F.col("a").alias("node")).agg(F.bool_or("more").alias("open")), "simhash-open")
        pairs = ranked.where(F.col("rank") <= most).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if sets is None:
            members = materialize(nodes.join(state.select("node").hint("merge"), "node"), "simhash-members")
            sets = materialize(member_sets(docs, members, words_per_shingle), "simhash-sets")
            checked = materialize(alike(pairs, sets), "simhash-pairs")
            edges = checked.where("like").select("a", "b")
        else:
            new = materialize(alike(pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti"), sets), "simhash-pairs")
            checked = checked.unionByName(new)
            edges = roots.toDF("a", "b").unionByName(new.where("like").select("a", "b"))
        roots = connected_components(edges, "simhash-stars")
        if not state.where("open").limit(1).count():
            return roots
        bounds = sets.select("node", "size", "parity")
        live = members.join(state, "node").join(bounds, "node").join(roots, "node", "left")
        live = live.select("node", *words, "open", "size", "parity", F.coalesce("root", "node").alias("root"))
        most *= MORE_PAIRS


def keep_one(docs: DataFrame, words_per_shingle: int = 5, threshold: int = NEAR_BITS, size: int = 2) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row of the smallest doc_id stays.

    Texts are joined where the Jaccard likeness of their shingle sets is at least
    ``LIKE``.  Rows of one doc_id with other texts are documents of their own;
    rows equal in doc_id and text are reduced to one.  Rows without a doc_id stay.
    """
    words = _prints(size)
    prints = materialize(set_prints(docs, words_per_shingle, size), "simhash-prints")
    nodes = materialize(prints.groupBy("node", *words).agg(F.min("doc_id").alias("doc_id")), "simhash-nodes")
    stars = materialize(like_components(docs, nodes, words_per_shingle, threshold, size), "simhash-stars")
    named = prints.where("doc_id is not null").select("doc_id", "key", "node")
    rooted = named.join(stars.hint("merge"), "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "simhash-rooted")
    # Dealt anew, so that the engine can split the join of a group that very many rows share.
    first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first")).repartition("root")
    late = (F.col("doc_id") != F.col("first.doc_id")) | (F.col("key") != F.col("first.key"))
    drop = rooted.join(first.hint("merge"), "root").where(late).select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"))
    drop = materialize(drop.distinct(), "simhash-drop")
    keyed = docs.withColumn("__doc", F.col("doc_id").cast("long")).withColumn("__key", _text_key())
    kept = without(keyed, drop)
    if named.groupBy("doc_id", "key").count().where("count > 1").limit(1).count():
        ids = kept.where("doc_id is not null").dropDuplicates(["doc_id", "__key"])
        kept = ids.unionByName(kept.where("doc_id is null"))
    return kept.select(*docs.columns)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, fingerprint, component_id."""
    from glossmill.llm.common import table

    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
