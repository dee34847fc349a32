"""Quality classifier: a linear support vector machine on naive-Bayes-scaled n-grams.

Features are indicators of n-grams of two streams: words (one and two of them)
and word shapes (one to three), where a shape tells the case pattern, the closing
mark, a number and whether the word repeats the one before.  They are hashed into
``1 << LOG_BUCKETS`` columns.  Each indicator is scaled by the log ratio of its
smoothed counts in the two classes, the row is brought to unit length, and a
hinge-loss linear model is fitted by dual coordinate descent with class weights.
A sigmoid over the margins, fitted on a slice of the training rows the model has
not seen, turns them into scores.

The class counts behind the ratios and the model come from a bounded sample of
labelled rows: at most ``max_rows``, the ones of least hash of doc_id, drawn only
from the training folds (crc32 of the doc_id as text, mod 5, is not 0), and of
those the first whose features take at most ``max_bytes``.  Features of the sample
are written to the shared folder and read from there.  Labels, language, source
and id are never features.  Scoring covers every row.

Defined cases: a null text counts as empty; an empty text has no features and
scores by the intercept alone; labels that are null or have no document are left
out; a doc_id labelled twice counts twice; with one class or no labels at all
every score is the share of label 1 (0.5 without labels); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import dataset
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import on_driver, shielded, small_batches, table, text_or_empty, unshielded, written
from glossmill.llm.hashing import mix, word_hashes

LOG_BUCKETS = 18
#: Most labelled rows used for fitting.
MAX_ROWS = 12_000
#: Most bytes of their features, four each; a row is in or out as a whole.
MAX_BYTES = 128 << 20
THRESHOLD = 0.3
FOLDS = 5

#: Byte classes of shapes: 0 other, 1 lower, 2 upper, 3 digit, 4 stop, 5 comma-like, 6 symbol, 7 beyond ASCII.
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[ord(c) for c in ".?"]] = 4
_CLASS[[ord(c) for c in ",;:"]] = 5
_CLASS[128:] = 7
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _shapes(text: str, words: np.ndarray) -> np.ndarray:
    """A small number for every word of a text: first, second and last class, and repetition."""
    data = np.frombuffer(text.encode(), np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[data], [True])).astype(np.int8))
    starts, stops = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    kind = _CLASS[data].astype(np.uint64)
    again = np.zeros(len(words), np.uint64)
    again[1:] = words[1:] == words[:-1]
    second = kind[np.minimum(starts + 1, stops - 1)]
    return kind[starts] | second << np.uint64(3) | kind[stops - 1] << np.uint64(6) | again << np.uint64(9)


def columns_of(text: str | None) -> np.ndarray:
    """Sorted distinct feature columns of a text."""
    text = text or ""
    words = word_hashes(text)
    if not len(words):
        return np.zeros(0, np.int64)
    shapes = mix(_shapes(text, words) + np.uint64(1 << 20))
    odd = np.uint64(0x9E3779B97F4A7C15)
    parts = [words, words[:-1] * odd + words[1:], shapes, shapes[:-1] * odd + shapes[1:]]
    if len(shapes) > 2:
        parts.append((shapes[:-2] * odd + shapes[1:-1]) * odd + shapes[2:])
    mixed = mix(np.concatenate(parts))
    return np.unique((mixed >> np.uint64(64 - LOG_BUCKETS)).astype(np.int64))


class Model:
    """Weights per column (ratio and hinge weight in one), intercept, and the sigmoid."""

    def __init__(self, weights: np.ndarray, ratios: np.ndarray, intercept: float, slope: float, shift: float):
        self.weights, self.ratios, self.intercept, self.slope, self.shift = weights, ratios, intercept, slope, shift

    def margin(self, columns: np.ndarray) -> float:
        scaled = self.ratios[columns]
        norm = float(np.sqrt(scaled @ scaled)) or 1.0
        return float(self.weights[columns] @ scaled) / norm + self.intercept

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(columns_of(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """The log ratio of smoothed, normalised indicator counts of the two classes."""
    counts = np.full((2, 1 << LOG_BUCKETS), smooth)
    for row, y in zip(rows, labels):
        counts[int(y > 0), row] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    seen = counts.sum(axis=0) > 2 * smooth
    return np.where(seen, np.log(shares[1] / shares[0]), 0.0)


def coordinate_descent(
    rows: list[np.ndarray], ratios: np.ndarray, labels: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights and intercept of the hinge-loss model over scaled unit rows, by its dual."""
    share = max(1e-9, float(np.mean(labels > 0)))
    upper = np.where(labels > 0, cost / (2 * share), cost / max(1e-9, 2 * (1 - share)))
    norms = np.array([float(np.sqrt(ratios[row] @ ratios[row])) for row in rows])
    weights, intercept = np.zeros(len(ratios)), 0.0
    alpha = np.zeros(len(rows))
    # A unit row with a constant column of 1 has squared length 2; a row without weight has 1.
    square = np.where(norms > 0, 2.0, 1.0)
    norms[norms == 0] = 1.0
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            row, y = rows[i], labels[i]
            v = ratios[row] / norms[i]
            slope = y * (float(weights[row] @ v) + intercept) - 1.0
            new = min(max(alpha[i] - slope / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * y
            if step:
                weights[row] += step * v
                intercept += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights, intercept


def _sigmoid(margins: np.ndarray, labels: np.ndarray, rounds: int = 400) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, with smoothed targets."""
    high, low = np.sum(labels > 0), np.sum(labels <= 0)
    target = np.where(labels > 0, (high + 1) / (high + 2), 1 / (low + 2))
    slope, shift = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -40, 40)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([np.sum((p - target) * margins) + 1e-3 * slope, np.sum(p - target)])
        h = np.array([[np.sum(w * margins**2) + 1e-3, np.sum(w * margins)], [np.sum(w * margins), np.sum(w)]])
        d = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        slope, shift = slope - d[0], shift - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return max(float(slope), 1e-6), float(shift)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of feature rows with labels 1 and -1; every fifth row fits the sigmoid."""
    size = 1 << LOG_BUCKETS
    if len(set(labels.tolist())) < 2:
        share = float(np.clip(np.mean(labels > 0), 0.01, 0.99)) if len(labels) else 0.5
        return Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
    part = np.arange(len(rows)) % 5 == 4
    if len(set(labels[part].tolist())) < 2 or len(set(labels[~part].tolist())) < 2:
        part[:] = False
    train = [r for r, p in zip(rows, part) if not p]
    ratios = log_count_ratios(train, labels[~part])
    weights, intercept = coordinate_descent(train, ratios, labels[~part])
    model = Model(weights, ratios, intercept, 1.0, 0.0)
    held = part if part.any() else ~part
    margins = np.array([model.margin(r) for r, p in zip(rows, held) if p])
    model.slope, model.shift = _sigmoid(margins, labels[held])
    return model


def is_held_out(doc_id):
    """The column that tells the held-out fold."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Fit on at most ``max_rows`` labelled documents of the training folds."""
    small_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id").alias("order")
    chosen = known.where(~is_held_out("doc_id")).select("*", order).orderBy("order", "doc_id", "quality").limit(max_rows)
    joined = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    names = ["order", "doc_id", "quality", "size", "row"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [columns_of(t).astype(np.int32).tobytes() for t in batch.column(3).to_pylist()]
            size = pa.array([len(r) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], size, pa.array(rows, pa.binary())], names=names)

    source = joined.select("order", F.col("doc_id").cast("long").alias("doc_id"), "quality", "text")
    path = written(source.mapInArrow(extract, "order long, doc_id long, quality int, size long, row binary"), "quality-sample")
    sizes = on_driver(path, ["order", "size"])
    by = np.argsort(sizes["order"].to_numpy(), kind="stable")
    within = np.cumsum(sizes["size"].to_numpy()[by]) <= max_bytes
    if not within.any():
        return fit([], np.zeros(0))
    last = int(sizes["order"].to_numpy()[by][within][-1])
    found = on_driver(path, ["doc_id", "quality", "row"], dataset.field("order") <= last).combine_chunks()
    ids, quality, raw = (found[n].to_pylist() for n in ("doc_id", "quality", "row"))
    place = sorted(range(len(ids)), key=lambda i: (hash((ids[i], 11)) & 0xFFFF, ids[i], raw[i]))
    rows = [np.frombuffer(raw[i], np.int32) for i in place]
    return fit(rows, np.array([1.0 if quality[i] > 0 else -1.0 for i in place]))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` with ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores = [own.score(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(scores, pa.float64())], names=[*keep, "score"]
            )

    return docs.select(*keep, text_or_empty().alias("__text")).mapInArrow(run, ", ".join([*kinds, "score double"]))


def keep_good(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows the classifier rejects; it is trained on ``all_docs``."""
    safe, names = shielded(docs)
    scored = score(safe, train(all_docs, labels), names)
    return unshielded(scored.where(F.col("score") >= threshold), names, docs.columns)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
