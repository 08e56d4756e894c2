"""Every query with SQL gives the same rows in both engines; the others run and keep their columns."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import __spark_entry__ as entry  # noqa: E402
from tools.check_queries import compare, connect  # noqa: E402

SLOW: set[str] = set()


@pytest.fixture(scope="session")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows_as_sql(spark, folder, duck, name):
    df = entry.queries()[name](spark, folder)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert compare(df.columns, [tuple(r) for r in df.collect()], columns, result.fetchall()) == "ok"


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_runs(spark, folder, name):
    assert entry.queries()[name](spark, folder).collect()


def test_entry(spark):
    assert entry.entry(spark).columns == ["category", "positive", "neutral", "negative", "total", "sentiment_score"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
