"""Shared plumbing: table access, the shared work folder, materialisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes that an Arrow batch carries to Python; they bound a worker's memory for long texts.
ARROW_ROWS, ARROW_BYTES = 1000, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder, read by Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch for the Python stages planned after this.

    Plans read the setting when they run, so it stays set for the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only where a session of one
    machine has none (tests) is a temporary folder made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='glossmill-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/glossmill/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> str:
    """The path below the shared folder to which ``df`` is written."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The table survives the loss of any executor, unlike a local checkpoint.
    """
    return df.sparkSession.read.schema(df.schema).parquet(written(df, label))


def on_driver(path: str, columns: list[str], where=None):
    """Columns of a written table of bounded size as an Arrow table; it does not pass through the driver's JVM."""
    from pyarrow import dataset, fs

    store, root = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    return dataset.dataset(root, filesystem=store, format="parquet").to_table(columns=columns, filter=where)


def hot_keys(counts: DataFrame, key: str, rows: str) -> list:
    """The keys that hold more than their share of a table's rows.

    ``counts`` is a materialised table with the number of rows of every key (those
    without repeats may be left out).  A share is a quarter of an even partition
    of what it counts, so at most four keys a partition come out, whatever the data.
    """
    parts = 4 * parallelism(counts.sparkSession)
    total = counts.agg(F.sum(rows)).first()[0] or 0
    return [r[0] for r in counts.where(F.col(rows) > max(total // parts, 64)).select(key).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: list, by: list[str], how: str) -> DataFrame:
    """An equi-join in which the rows of hot keys of ``left`` are dealt over salts, by a hash of the columns ``by``.

    Rows of ``right`` with a hot key are repeated once for each of its salts.
    """
    salts = parallelism(left.sparkSession)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    dealt = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).otherwise(0))
    every = F.sequence(F.lit(0), F.when(is_hot, salts - 1).otherwise(0))
    return dealt.join(right.withColumn("__salt", F.explode(every)), [key, "__salt"], how).drop("__salt")


def text_or_empty(column: str = "text"):
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def shielded(docs: DataFrame, needed: tuple[str, ...] = ("doc_id", "text")) -> tuple[DataFrame, list[str]]:
    """``docs`` with every column but ``needed`` renamed out of the way, and all its columns in order.

    Operators that add columns of their own work on these; ``unshielded`` undoes it.
    """
    names = [n if n in needed else f"__kept_{i}" for i, n in enumerate(docs.columns)]
    return docs.toDF(*names), names


def unshielded(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """The columns ``names`` of a shielded table under their own names."""
    return df.select(*names).toDF(*columns)


def parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
