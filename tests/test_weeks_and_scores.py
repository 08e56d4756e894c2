from datetime import date

import pytest
from pyspark.sql import functions as F

from opinara.functions import scores, weeks
from opinara.functions.binding import let


def values(spark, column, rows, schema):
    df = spark.createDataFrame(list(enumerate(rows)) if not isinstance(rows[0], tuple) else rows, schema)
    return [r["c"] for r in df.select(df.columns[0], column.alias("c")).orderBy(df.columns[0]).collect()]


def test_week_labels(spark):
    dates = ["2024-12-30", "2025-01-15", "2021-01-03", "2020-12-31", "", None, "n/a", "2025", "2025-1-5", "2025-13-01",
             "20250115", "2025-01-15T10:00:00", "2025-01-15 10:00:00+05:30", "2025-01-15x"]
    want = ["2025-W01", "2025-W03", "2020-W53", "2020-W53", "unknown", "unknown", "unknown", "unknown", "unknown", "unknown",
            "2025-W03", "2025-W03", "2025-W03", "unknown"]
    assert values(spark, weeks.week_label(F.col("d")), dates, "i int, d string") == want


def test_every_day_of_years_matches_the_calendar(spark):
    days = spark.sql("SELECT explode(sequence(date'2015-01-01', date'2030-12-31')) AS d")
    for row in days.select("d", weeks.week_of(F.col("d")).alias("w")).collect():
        year, week, _ = row["d"].isocalendar()
        assert row["w"] == f"{year}-W{week:02d}"


def test_request_dates():
    assert weeks.week_of_parameter("2024-12-30") == "2025-W01"
    with pytest.raises(ValueError, match="INVALID_DATE"):
        weeks.parse_iso("15/01/2025")
    assert weeks.preset_range("30d", date(2025, 1, 31)) == ("2025-01-01", "2025-01-31")
    assert weeks.preset_range("all", date(2025, 1, 31)) == ("", "")


def test_packed_keys(spark):
    keys = ["ISSUE#fit#per_category#2025-W03", "ISSUE#fit#2025-W03", "ISSUE#a#b#c#d", "TREND#x#2025-W01", "CAT#a#b"]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    rows = df.select(
        "i", weeks.unpack_issue(F.col("k")).alias("issue"), weeks.unpack_trend(F.col("k")).alias("trend"),
        weeks.unpack_category(F.col("k")).alias("category"),
    ).orderBy("i").collect()
    assert [r["issue"] and tuple(r["issue"]) for r in rows] == [
        ("fit", "per_category", "2025-W03"), ("fit", "cross_category_fallback", "2025-W03"), None, None, None,
    ]
    assert [r["trend"] and tuple(r["trend"]) for r in rows] == [None, None, None, ("x", "2025-W01"), None]
    assert [r["category"] for r in rows] == [None, None, None, None, "a#b"]


PROBS = [
    (0, 0.5, 0.5, 0.0),
    (1, 0.1, 0.2, 0.7),
    (2, 0.3, 0.3, 0.4),
    (3, 0.8, 0.1, 0.1),
    (4, 0.4, 0.2, 0.4),
    (5, 0.15, 0.275, 0.575),
]
SCHEMA = "i int, prob_negative double, prob_neutral double, prob_positive double"


def test_argmax_and_rules(spark):
    probs = scores.probabilities()
    assert values(spark, scores.argmax(probs), PROBS, SCHEMA) == [0, 2, 2, 0, 0, 2]
    decided = scores.asymmetric_rule(scores.argmax(probs), F.round(scores.margin(probs), 6))
    assert values(spark, decided, PROBS, SCHEMA) == [0, 2, 1, 0, 0, 2]  # a margin of exactly 0.30 stays positive
    soft = scores.symmetric_rule(scores.argmax(probs), scores.margin(probs), 0.15)
    assert values(spark, soft, PROBS, SCHEMA) == [1, 2, 1, 0, 1, 2]


def test_softmax_and_norm(spark):
    rows = [(0, [1000.0, 1000.0, 1000.0]), (1, [0.0, 0.0, 0.0])]
    got = values(spark, scores.softmax(F.col("v")), rows, "i int, v array<double>")
    assert got[0] == pytest.approx([1 / 3] * 3)
    assert values(spark, scores.l2_normalise(F.col("v")), rows, "i int, v array<double>")[1] == [0.0, 0.0, 0.0]


def test_small_scalars(spark):
    assert values(spark, scores.number_or_zero(F.col("t")), ["0.25", "x", "", None], "i int, t string") == [0.25, 0, 0, 0]
    assert values(spark, scores.label_from_stars(F.col("s")), [1, 2, 3, 4, 5, 9], "i int, s int") == [
        "negative", "negative", "neutral", "positive", "positive", None,
    ]
    assert values(spark, scores.tag_title(F.col("t")), ["sizing_and_fit"], "i int, t string") == ["sizing and fit"]
    assert values(spark, scores.shorten(F.col("t"), 3), ["abc", "abcd"], "i int, t string") == ["abc", "abc…"]
    assert values(spark, scores.margin_bucket(F.col("m")), [0.15, 0.1501], "i int, m double") == ["uncertain", "confident"]
    assert values(spark, let(F.col("m") + 1, lambda x: x * x), [1, 2], "i int, m int") == [4, 9]


def test_iso_forms_as_python_reads_them(spark):
    from datetime import datetime

    from pyspark.sql import functions as F

    from opinara.functions import weeks

    texts = ["2031-05-09", "20310509", "2031-W19-5", "2031W195", "2031-W19", "2026-W53-7", "2031-W53-1", "2031-02-30", "2031-W00-1", "20310509T0102", "2031-05-09 7", "2031-W19-8", ""]
    shown = spark.createDataFrame([(t,) for t in texts], "t string").select("t", weeks.iso_date(F.col("t")).alias("d")).collect()

    def read(text):
        try:
            return datetime.fromisoformat(text).date()
        except ValueError:
            return None

    assert [r.d for r in shown] == [read(t) for t in texts]
