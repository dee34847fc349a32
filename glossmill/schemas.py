"""Schemas of the tables that operators share, and checks on them."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TOKENS = (
    "book string, sentence_id long, position int, surface string, lemma string, pos string, is_stop boolean, "
    "is_alpha boolean, whitespace string"
)
KNOWN_WORDS = "lemma string, status string, item_type string, tags string, synset_id string"
CARD = (
    "meaning_id int, definition_en string, definition_ru string, part_of_speech string, "
    "selected_example_indices string, generated_example string"
)


def require_columns(df: DataFrame, columns: tuple[str, ...] | list[str], name: str) -> DataFrame:
    """``df``, or ValueError naming the columns that are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing required columns: {missing}")
    return df


#: Arrow types of the columns of fixed tables, by their names in SQL.
_TYPES = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}


def fixed_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table of given rows that the optimizer knows the size of.

    Rows that go through Arrow become a local relation, so joins with it are
    broadcast by its own size and the other side is not shuffled.
    """
    names, kinds = zip(*(column.split(" ") for column in schema.split(", ")))
    rows = list(rows)
    columns = [pa.array([r[i] for r in rows], _TYPES[kind]) for i, kind in enumerate(kinds)]
    return spark.createDataFrame(pa.table(columns, names=list(names)))
