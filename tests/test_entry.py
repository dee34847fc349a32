"""The driver's entry and the queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["txt_1", "txt_4", "agg_1", "rnk_1", "rnk_3", "agg_3", "agg_6", "jn_12", "agg_4", "agg_13", "smp_2", "plan_vocabulary"]


def same(spark, name, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def plain(frame):
        return sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))

    assert plain(got) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    same(spark, name)


def test_library_does_not_import_the_corpus_operators():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for path in glob.glob(f"{root}/glossmill/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path, encoding="utf-8") as source:
                assert "glossmill.llm" not in source.read(), path
