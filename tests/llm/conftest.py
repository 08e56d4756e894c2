import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))

SCHEMA = "doc_id long, text string, lang string, row int, _row string, score double, shard string"


def odd_rows():
    """Nulls, empty, very long, repeated and equal rows, in a table whose other columns have clashing names."""
    long_text = "alpha beta, gamma delta. " * 20_000
    texts = [(None, None), (None, "x"), (1, ""), (2, " \n\t "), (3, "Alpha beta"), (3, "Alpha beta"), (4, long_text), (5, "alpha beta"), (6, "é" * 300), (3, "other")]
    return [(i, t, None, n, "r", 0.5, None) for n, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, folder):
    from opinara.llm import tables

    return {name: tables.table(spark, folder, name) for name in ("documents", "labels", "pages", "benchmark")}
