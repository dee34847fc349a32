"""Filter interaction audit: what each filter does in every order of five filters.

A document is, for the filters, the set of those it fails: one of 32 masks.  In a
given order and step everything that can be said of it (kept, removed here,
removed before although this filter would, failing nothing else) follows from the
mask.  So the table is reduced to histograms over masks, and all 600 outcomes of a
part (120 orders of 5 steps) are one product of its histograms with fixed
integer matrices of 32 rows and 600 columns, one matrix an outcome.

The filters are column expressions over whole texts.  A document fails the
duplicate filter if its text occurs with a smaller id.  For that, rows are first
counted per (digest, mask, part, labels) with the least id and the rows that have
it: map-side sums reduce a text that a third of the rows share before it is
shuffled, and no text travels, only its digest.  The products run in tasks, a
batch of parts at a time, since the number of parts is that of the sources.

Defined cases: a null text counts as empty, and empty texts are equal to each
other; a null source is the part of the empty name; a null id is not smaller than
any and none is smaller than it, so such rows never fail the duplicate filter,
and they have no labels; rows that repeat an id and a text both stay, since
neither id is smaller; an id labelled more than once is good (or toxic) if one of
its labels says so; an empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.llm.common import table, text_or_empty

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MASKS, STEPS = 1 << len(FILTERS), len(FILTERS)
CELLS = len(ORDERS) * STEPS
OUTCOMES = ("kept", "removed", "redundant", "unique_fails")
#: Parts in one product; bounds its memory.
PARTS = 256
COLUMNS = (*OUTCOMES, "good_lost", "toxic_lost", "shapley")


def incidence() -> dict[str, np.ndarray]:
    """Per outcome the 32 x 600 matrix of 0 and 1 that says which masks count at which order and step.

    ``shapley`` is no outcome of a step: a mask counts as often as there are
    orders in which the step's filter is the one that removes it.
    """
    fails = (np.arange(MASKS)[:, None] >> np.arange(STEPS)) & 1
    order = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    here = fails[:, order]
    gone = np.cumsum(here, axis=2) > 0
    before = np.concatenate([np.zeros_like(gone[:, :, :1]), gone[:, :, :-1]], axis=2)
    removed = (here == 1) & ~before
    by_filter = np.stack([(removed & (order == f)).sum(axis=(1, 2)) for f in range(STEPS)], axis=1)
    found = {
        "kept": ~gone,
        "removed": removed,
        "redundant": (here == 1) & before,
        "unique_fails": (here == 1) & (fails.sum(axis=1) == 1)[:, None, None],
        "shapley": by_filter[:, order],
    }
    return {name: m.reshape(MASKS, CELLS).astype(np.int64) for name, m in found.items()}


def failed(text: Column) -> Column:
    """The mask of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = (
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        100 * capitals > 5 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    )
    return sum((F.when(test, 1 << i).otherwise(0) for i, test in enumerate(tests)), F.lit(0))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of every row; no text leaves its task."""
    text = text_or_empty()
    return docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        failed(text).alias("mask"),
    )


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of every mask, of all rows and of those labelled."""
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"),
    )
    named = (
        features(docs.where("doc_id IS NOT NULL"))
        .join(known, "doc_id", "left")
        .fillna(0, ["good", "toxic"])
        .groupBy("doc_id", "digest", "mask", "part", "good", "toxic")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    keys = ["mask", "part", "good", "toxic"]
    copies = named.groupBy("digest", *keys).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("least"))
    least = F.min("least.doc_id").over(Window.partitionBy("digest"))
    copies = copies.withColumn("first", F.when(F.col("least.doc_id") == least, F.col("least.n")).otherwise(0))
    split = copies.select(
        "part",
        "good",
        "toxic",
        F.inline(
            F.array(
                F.struct(F.col("mask"), F.col("first").alias("n")),
                F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("first")).alias("n")),
            )
        ),
    )
    nameless = features(docs.where("doc_id IS NULL")).select("part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "mask", F.lit(1).cast("long").alias("n"))
    return (
        split.unionByName(nameless)
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("good")).alias("good"),
            F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
        )
    )


def outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """600 rows for each part, by products of the stacked histograms of some parts at once."""
    matrices = incidence()
    orders = pa.array(np.repeat(ORDERS, STEPS).tolist())
    steps = pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))
    for batch in (b.slice(at, PARTS) for b in batches for at in range(0, b.num_rows, PARTS)):
        parts = batch.column(0).to_pylist()
        stacked = np.zeros((3, len(parts), MASKS), np.int64)
        for row, bins in enumerate(batch.column(1).to_pylist()):
            for entry in bins:
                stacked[:, row, entry["mask"]] = entry["n"], entry["good"], entry["toxic"]
        every, good, toxic = stacked
        found = {name: every @ m for name, m in matrices.items()}
        found |= {"good_lost": good @ matrices["removed"], "toxic_lost": toxic @ matrices["removed"]}
        for row, part in enumerate(parts):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * CELLS), orders, steps, *(pa.array(found[c][row]) for c in COLUMNS)],
                names=["part", "filter_order", "step", *COLUMNS],
            )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    bins = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("bins")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COLUMNS)
    return histograms(docs, labels).groupBy("part").agg(bins).mapInArrow(outcomes, schema)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole ``documents`` and ``labels`` tables."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts
), fails AS (
  SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w),
                100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
                doc_id > min(doc_id) OVER (PARTITION BY text)] AS f,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM words LEFT JOIN labels USING (doc_id)
), counted AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY part, f
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, [position(substr(filter_order, s, 1) IN 'ABCDE') FOR s IN range(1, step)] AS earlier,
         position(substr(filter_order, step, 1) IN 'ABCDE') AS own
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), cells AS (
  SELECT *, len([i FOR i IN earlier IF f[i]]) > 0 AS gone, f[own] AS here, len([i FOR i IN f IF i]) = 1 AS alone FROM counted, steps
), summed AS (
  SELECT part, filter_order, step, own, sum(CASE WHEN NOT gone AND NOT here THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN NOT gone AND here THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND here THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN here AND alone THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN NOT gone AND here THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND here THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""
