"""Comparisons and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(expected: DataFrame, actual: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, outcome, differing): missing, extra, different or equal rows of two tables.

    List fields compare without regard to order.
    """

    def value(side: str, field: str):
        column = F.col(f"{side}.{field}")
        return F.array_sort(column) if expected.schema[field].dataType.typeName() == "array" else column

    same_keys = [F.col(f"e.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys]
    e = expected.withColumn("__e", F.lit(True)).alias("e")
    a = actual.withColumn("__a", F.lit(True)).alias("a")
    condition = same_keys[0]
    for c in same_keys[1:]:
        condition = condition & c
    differing = F.array_compact(F.array(*[F.when(~value("e", f).eqNullSafe(value("a", f)), F.lit(f)) for f in fields]))
    outcome = (
        F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "extra").when(F.size(differing) > 0, "different").otherwise("equal")
    )
    both = F.col("__a").isNotNull() & F.col("__e").isNotNull()
    return e.join(a, condition, "full").select(
        *[F.coalesce(f"e.{k}", f"a.{k}").alias(k) for k in keys],
        outcome.alias("outcome"),
        F.when(both, F.array_join(differing, ",")).otherwise(F.lit("")).alias("differing"),
    )


def changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) of rows right in one run and wrong in the other."""
    joined = old.select(key, F.col("is_correct").alias("before")).join(new.select(key, F.col("is_correct").alias("after")), key)
    change = F.when(~F.col("before") & F.col("after"), "improved").when(F.col("before") & ~F.col("after"), "regressed")
    return joined.select(key, change.alias("change")).where("change is not null")


def group_sizes(df: DataFrame, key: str) -> DataFrame:
    """(size, n): how many keys have how many rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))
