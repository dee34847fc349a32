"""Stores that are folders: sheets of words, tagged runs, and checkpoints of long work."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.schemas import KNOWN_WORDS


class _Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, below: str = "") -> list[str]:
        """The entries of a folder, by name."""
        at = self._of(self.path + below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []


class Sheet(_Folder):
    """Known words of one worksheet; a save is a new version, so a table read from an older one stays whole."""

    def exists(self) -> bool:
        return bool(self._versions())

    def _versions(self) -> list[str]:
        return [n for n in self.names() if n.startswith("v") and self._fs.exists(self._of(f"{self.path}/{n}/_SUCCESS"))]

    def load(self) -> DataFrame:
        have = self._versions()
        return self.spark.read.schema(KNOWN_WORDS).parquet(f"{self.path}/{have[-1]}") if have else self.spark.createDataFrame([], KNOWN_WORDS)

    def save(self, words: DataFrame) -> None:
        n = int(self._versions()[-1][1:9]) + 1 if self.exists() else 1
        words.write.parquet(f"{self.path}/v{n:08d}-{uuid.uuid4().hex}")


class Sheets:
    """Worksheets below a folder, made by their first save; a network service can stand in for it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def worksheet(self, name: str, document: str = "local") -> Sheet:
        return Sheet(self.spark, f"{self.path}/{document}/{name}")


class Runs(_Folder):
    """Results of evaluation runs by tag."""

    def save(self, tag: str, results: DataFrame) -> None:
        results.write.mode("overwrite").parquet(f"{self.path}/tag={tag}")

    def load(self, tag: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/tag={tag}")

    def tags(self) -> list[str]:
        return [n.removeprefix("tag=") for n in self.names() if n.startswith("tag=")]


class Checkpoints(_Folder):
    """Rows of a long piece of work, kept by blocks of ``size`` values of a whole-number key."""

    def __init__(self, spark: SparkSession, path: str, key: str, size: int):
        super().__init__(spark, path)
        self.key, self.size = key, size

    def run(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame]) -> None:
        """Do what is not yet kept, and keep it by block."""
        left = rows.join(self.read().select(self.key), self.key, "left_anti") if self.names() else rows
        block = F.floor(F.col(self.key) / self.size).cast("long")
        work(left).withColumn("block", block).write.mode("append").partitionBy("block").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).withColumn("block", F.col("block").cast("long"))
