"""Exact order statistics against brute force, with slices forced to be tiny."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators import ranking


@pytest.fixture
def tiny_slices(monkeypatch):
    monkeypatch.setattr(ranking, "SLICE_ROWS", 3)


def test_hash_cuts_take_exact_counts(spark, tiny_slices):
    rows = [(i, "hot" if i % 3 else f"s{i % 2}") for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, s string")
    got = ranking.take_first_by_hash(df, ranking.hash_key(F.col("id"), 7), F.floor(F.col("total") * 0.3), ["s"])
    taken = {r["id"] for r in got.collect()}
    for stratum in {s for _, s in rows}:
        ids = sorted((hashlib.md5(f"7:{i}".encode()).hexdigest(), i) for i, s in rows if s == stratum)
        assert {i for _, i in ids[: int(len(ids) * 0.3)]} == {i for _, i in ids} & taken


def test_hash_cuts_with_null_and_empty_strata(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(100)], "id int, s string")
    got = ranking.take_first_by_hash(df, ranking.hash_key(F.col("id"), 1), F.lit(10), ["s"])
    assert got.filter("s IS NULL").count() == 10 and got.filter("s = 'a'").count() == 10
    none = ranking.take_first_by_hash(df.filter("id < 0"), ranking.hash_key(F.col("id"), 1), F.lit(10))
    assert none.count() == 0
    zero = ranking.take_first_by_hash(df, ranking.hash_key(F.col("id"), 1), F.lit(0))
    assert zero.count() == 0


def test_copies_of_a_key_stay_together(spark, tiny_slices):
    df = spark.createDataFrame([(i % 5,) for i in range(500)], "id int")
    got = ranking.take_first_by_hash(df, ranking.hash_key(F.col("id"), 1), F.lit(150))
    assert sorted(r["count"] for r in got.groupBy("id").count().collect()) == [100, 100]


def sample(kind, n=3000):
    rng = random.Random(5)
    if kind == "uniform":
        return [rng.random() for _ in range(n)]
    if kind == "one hot value":
        return [0.5 if rng.random() < 0.4 else rng.random() for _ in range(n)]
    if kind == "constant":
        return [2.0] * n
    if kind == "far apart":
        return [rng.choice([1e-9, 1.0, 1e12]) * (1 + rng.random() * 1e-6) for _ in range(n)]
    return [float(rng.randrange(7)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["uniform", "one hot value", "constant", "far apart", "few values"])
def test_percentiles_match_numpy(spark, tiny_slices, kind):
    values = sample(kind)
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    probs = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {r["p"]: r["percentile"] for r in ranking.exact_percentiles(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_percentiles_by_group(spark, tiny_slices):
    groups = {"a": sample("uniform", 700), "b": sample("one hot value", 300), "c": [1.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    for row in ranking.exact_percentiles(df, "v", [0.25, 0.9], by=["g"]).collect():
        assert row["percentile"] == pytest.approx(np.quantile(groups[row["g"]], row["p"]), rel=1e-12)
    assert ranking.exact_percentiles(df.filter("v > 5"), "v", [0.5]).count() == 0


def test_positions(spark):
    rows = [("2025-01-01" if i % 3 else "2025-01-02", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "d string, id int").repartition(7)
    got = ranking.with_position(df, F.desc("d"), F.asc("id")).orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(1, 1001))
    assert [(r["d"], r["id"]) for r in got] == sorted(rows, key=lambda r: (-int(r[0][-2:]), r[1]))


def test_small_side_broadcasts_only_within_its_limit(spark):
    big = spark.range(1000).withColumnRenamed("id", "k")
    side = spark.range(100).withColumnRenamed("id", "k").withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [
            big.join(ranking.small_side(side, limit), "k")._jdf.queryExecution().executedPlan().toString() for limit in (100, 99)
        ]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" in plans[1]


def test_percentiles_with_infinities(spark, monkeypatch):
    monkeypatch.setattr(ranking, "SLICE_ROWS", 5)
    values = [float("inf"), float("-inf"), 1e308, -1e308, *map(float, range(47))]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    found = {r.p: r.percentile for r in ranking.exact_percentiles(rows, "x", [0.0, 0.25, 0.5, 1.0]).collect()}
    assert found == {0.0: float("-inf"), 0.25: 10.5, 0.5: 23.0, 1.0: float("inf")}
