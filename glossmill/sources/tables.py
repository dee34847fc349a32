"""Tables, word lists, JSON lines and manifests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.schemas import KNOWN_WORDS

#: Version that written cards and batches have.
SCHEMA_VERSION = "1"


class KnownWordsSource(Protocol):
    """Where known words are kept; other stores implement the same three calls."""

    def load(self) -> DataFrame: ...

    def save(self, words: DataFrame) -> None: ...

    def exists(self) -> bool: ...


class CsvKnownWords:
    """Known words in CSV files with a header."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def load(self) -> DataFrame:
        """All rows; columns a file lacks are null, and a missing file has no rows."""
        if not self.exists():
            return self.spark.createDataFrame([], KNOWN_WORDS)
        rows = self.spark.read.csv(self.path, header=True)
        missing = {c: F.lit(None).cast("string") for c in ("lemma", "status", "item_type", "tags", "synset_id") if c not in rows.columns}
        return rows.withColumns(missing)

    def save(self, words: DataFrame) -> None:
        """The words in place of what is stored, one file a task; they may come from this store."""
        replace_files(self.spark, self.path, lambda draft: words.write.csv(draft, header=True))


def known_words(spark: SparkSession, source: str, sheets=None) -> KnownWordsSource:
    """The store of an address: ``gsheets://document/worksheet`` of the sheets given, else a CSV path."""
    if not source.startswith("gsheets://"):
        return CsvKnownWords(spark, source)
    document, _, name = source.removeprefix("gsheets://").partition("/")
    if not document or not name:
        raise ValueError(f"no document and worksheet in {source}")
    if sheets is None:
        raise ValueError("no service of sheets is built in; pass one, or stores.Sheets")
    return sheets.worksheet(name, document)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a given schema."""
    return spark.read.schema(schema).json(path)


def replace_files(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """What ``write`` writes, in place of what is at ``path``, whole or not at all.

    Files are written beside their place and renamed into it, so what is written may be read from there.
    """
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    draft, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    write(draft)
    there = fs.exists(of(path))
    if there:
        fs.rename(of(path), of(old))
    fs.rename(of(draft), of(path))
    if there:
        fs.delete(of(old), True)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """JSON lines in place of what is at ``path``, whole or not at all; ``rows`` may come from there."""
    replace_files(rows.sparkSession, path, rows.write.json)


def write_versioned(rows: DataFrame, path: str) -> None:
    """JSON lines with the current schema_version, whatever version the rows had."""
    write_json_lines(rows.withColumn("schema_version", F.lit(SCHEMA_VERSION)), path)


def lemma_examples(lines: DataFrame, column: str = "value") -> DataFrame:
    """(lemma, ord, sentence_id, text) of a JSON map of examples, plain texts or objects."""
    plain = F.from_json(column, "map<string,array<string>>")
    rich = F.from_json(column, "map<string,array<struct<sentence_id:bigint,text:string>>>")
    first = F.map_values(plain)[0][0]
    is_rich = F.coalesce(first.startswith("{"), F.lit(False))
    wrapped = F.transform_values(
        plain, lambda k, v: F.transform(v, lambda t: F.struct(F.lit(None).cast("bigint").alias("sentence_id"), t.alias("text")))
    )
    rows = lines.select(F.explode(F.when(is_rich, rich).otherwise(wrapped)).alias("lemma", "all"))
    return rows.select("lemma", F.posexplode("all").alias("ord", "e")).select("lemma", "ord", "e.*")


def lemma_pos(lines: DataFrame, column: str = "value") -> DataFrame:
    """(lemma, pos_list) of a JSON map of parts of speech."""
    return lines.select(F.explode(F.from_json(column, "map<string,array<string>>")).alias("lemma", "pos_list"))


def write_json(path: str, value: object) -> None:
    """One JSON file of the driver, whole or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, draft = tempfile.mkstemp(dir=target.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            json.dump(value, out, ensure_ascii=False, indent=2)
        os.replace(draft, target)
    except BaseException:
        os.unlink(draft)
        raise


def file_sha256(path: str) -> str:
    """The SHA-256 of a file of the driver."""
    with open(path, "rb") as stream:
        return hashlib.file_digest(stream, "sha256").hexdigest()


def table_checksum(df: DataFrame) -> DataFrame:
    """One row (n, checksum) that does not depend on the order of rows; equal rows do not cancel out."""
    each = F.xxhash64(*df.columns).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(each), F.lit(0)).cast("string").alias("checksum"))


def manifest(tokens: DataFrame, sentences: DataFrame, **fields: object) -> dict:
    """Counts and checksums of a book's tables, for ``write_json``."""
    t, s = table_checksum(tokens).first(), table_checksum(sentences).first()
    return {
        "schema_version": "1",
        "token_count": t["n"],
        "sentence_count": s["n"],
        "checksums": {"tokens": t["checksum"], "sentences": s["checksum"]},
        **fields,
    }


def with_schema_version(rows: DataFrame) -> DataFrame:
    """``rows`` with a schema_version; "0" where there is none."""
    if "schema_version" not in rows.columns:
        return rows.withColumn("schema_version", F.lit("0"))
    return rows.withColumn("schema_version", F.coalesce("schema_version", F.lit("0")))


def unfinished(examples: DataFrame, labels: DataFrame, key: str = "example_id") -> DataFrame:
    """Examples that have no label yet."""
    return examples.join(labels.select(key).distinct(), key, "left_anti")
