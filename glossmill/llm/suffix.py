"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai common prefixes."""

from __future__ import annotations

import numpy as np

#: Ends each text of a shard; no byte of UTF-8.
SEPARATOR = 0xFF
_SKIP = 8


def packed_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one big-endian number; zeros beyond the end."""
    out = np.zeros(len(data), np.uint64)
    padded = np.concatenate((data, np.zeros(_SKIP, np.uint8)))
    for i in range(_SKIP):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


class Deep:
    """The suffixes that share at least ``least`` bytes with a neighbour, and those of them that open such a group."""

    def __init__(self, n: int, least: int):
        self.least = least
        self.held = np.zeros(n, bool)
        self.heads = np.zeros(n, bool)


def suffix_array(data: np.ndarray, words: np.ndarray | None = None, least: int = _SKIP) -> tuple[np.ndarray, np.ndarray, Deep]:
    """(order, rank) of all suffixes of ``data``, and those that share ``least`` bytes (0, or eight doubled some times).

    Suffixes start sorted by eight bytes.  Each round sorts only those whose
    group is not yet single, by the rank of the suffix as far on as is known, and
    so doubles what is known.
    """
    n = len(data)
    kind = np.int32 if n < 1 << 31 else np.int64
    words = packed_words(data) if words is None else words
    order = np.argsort(words).astype(kind)
    sorted_words = words[order]
    # The suffix beyond the end is the least; so are all places beyond it.
    rank = np.empty(n + 1, kind)
    rank[n] = -1
    fresh = np.ones(n, bool)
    fresh[1:] = sorted_words[1:] != sorted_words[:-1]
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=kind), 0))
    slots = np.nonzero(~(fresh & np.concatenate((fresh[1:], [True]))))[0].astype(kind) if n else np.zeros(0, kind)
    known, deep, opened = _SKIP, Deep(n, least), slots[:0]
    if not least and n:
        deep.held[:], opened = True, np.zeros(1, kind)
    while len(slots):
        suffixes = order[slots]
        if known == least:
            deep.held[suffixes] = True
            heads = np.concatenate(([True], rank[suffixes[1:]] != rank[suffixes[:-1]]))
            opened = slots[heads]
        key = rank[suffixes].astype(np.int64) * (n + 1) + rank[np.minimum(suffixes.astype(np.int64) + known, n)] + 1
        by = np.argsort(key, kind="stable")
        suffixes, key = suffixes[by], key[by]
        order[slots] = suffixes
        fresh = np.ones(len(slots), bool)
        fresh[1:] = key[1:] != key[:-1]
        rank[suffixes] = np.maximum.accumulate(np.where(fresh, slots, 0))
        slots = slots[~(fresh & np.concatenate((fresh[1:], [True])))]
        known *= 2
    deep.heads[order[opened]] = True
    return order, rank[:n], deep


def common_prefixes(words: np.ndarray, order: np.ndarray, rank: np.ndarray, deep: Deep, most: int) -> np.ndarray:
    """For every suffix of ``deep`` the common prefix with the suffix sorted just before it, up to ``most``; 0 if below its least.

    Kasai's rule, that moving on by one loses at most one, runs along each stretch
    of neighbouring places; all stretches take their steps together.
    """
    n = len(words)
    padded = np.concatenate((words, np.zeros(most + 2 * _SKIP, np.uint64)))
    out = np.zeros(n, np.int32)
    edge = np.diff(np.concatenate(([0], deep.held.view(np.int8), [0])))
    starts = np.nonzero(edge == 1)[0]
    lengths = np.nonzero(edge == -1)[0] - starts
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    live = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")
    shared = np.zeros(len(starts), np.int64)
    for step, width in enumerate(live.tolist()):
        here = starts[:width] + step
        opens = deep.heads[here]
        before = order[rank[here] - 1]
        height = np.maximum(shared[:width] - 1, deep.least)
        height[opens] = 0
        going = np.nonzero(~opens & (height < most))[0]
        while len(going):
            h = height[going]
            differ = padded[here[going] + h] ^ padded[before[going] + h]
            same = differ == 0
            rest = differ[~same]
            more = np.zeros(len(rest), np.int64)
            for bits, gain in ((32, 4), (16, 2), (8, 1)):
                equal = (rest >> np.uint64(64 - bits)) == 0
                more += equal * gain
                rest = np.where(equal, rest << np.uint64(bits), rest)
            height[going[~same]] += more
            height[going[same]] += _SKIP
            going = going[same]
            going = going[height[going] < most]
        height = np.minimum(height, most)
        shared[:width] = height
        out[here] = height
    return out


def repeated_starts(texts: list[bytes], length: int, times: list[int] | None = None) -> list[np.ndarray]:
    """For each text, whether the ``length`` bytes from each place on also start elsewhere among ``texts``.

    A text stands for so many equal ones as ``times`` says.  The result of a text
    has one flag for each place from which ``length`` bytes follow.
    """
    if not texts:
        return []
    mark = bytes([SEPARATOR])
    data = np.frombuffer(mark.join(texts) + mark, np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    words = packed_words(data)
    least = _SKIP if length >= _SKIP else 0
    while 0 < least * 2 <= length:
        least *= 2
    order, rank, deep = suffix_array(data, words, least)
    high = common_prefixes(words, order, rank, deep, length + _SKIP) >= length
    after = np.zeros(len(data), bool)
    after[order[:-1]] = high[order[1:]]
    flags = high | after
    out = [flags[s : s + max(0, n - length + 1)] for s, n in zip(starts.tolist(), lengths.tolist())]
    # Every suffix of a text that stands for several has its like in the others.
    return [f | (n > 1) for f, n in zip(out, times)] if times else out
