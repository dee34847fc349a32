"""Connected components of a large graph by alternating star contractions.

Each round is two aggregations and two joins over the remaining edges; nothing
is collected but a count and a checksum.  A node with very many neighbours is
met by partial aggregation and by the engine's skew join, never by a list: the
least neighbours are dealt anew before they are joined, since the engine splits a
join only where both its sides come straight from a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.llm.common import materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
    ).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("w")).unionByName(
        edges.select(F.col("v").alias("n"), F.col("u").alias("w"))
    )
    least = both.groupBy("n").agg(F.least(F.min("w"), F.col("n")).alias("m")).repartition("n")
    return (
        both.where("w > n")
        .join(least, "n")
        .where("w <> m")
        .select(F.col("w").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.repartition("u"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node of its component.

    ``edges`` has two long columns ``a`` and ``b``; direction, loops and repeats
    do not matter.  An empty edge table gives an empty result.
    """
    now = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        label,
    )
    before = _signature(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        now = materialize(_small_star(_large_star(now)), label)
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
