from pyspark.sql import functions as F

from opinara.operators import rollups
from opinara.plans import driver_views as V
from opinara.session import run_folder
from opinara.sources import tables
from opinara.streaming import reviews as S


def stream_of(spark, path, schema, per_trigger=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def test_counters_grow_over_runs(spark, folder):
    events = V.table(spark, folder, "events")
    inbox, out, state = run_folder(spark, "inbox"), run_folder(spark, "out"), run_folder(spark, "state")
    for part in (events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1")):
        part.coalesce(1).write.mode("append").parquet(inbox)
        counters = S.running_counters(V.review_shape(stream_of(spark, inbox, events.schema)))
        S.finish(S.upsert_counters(counters, out, state))
    want = rollups.trend_weekly(V.review_shape(events))
    assert sorted(map(tuple, S.read_counters(spark, out).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_new_checkpoint_replaces_old_totals_and_nothing_piles_up(spark, folder):
    events = V.table(spark, folder, "events")
    inbox, out = run_folder(spark, "inbox"), run_folder(spark, "out")
    want = None
    for _ in range(2):
        events.repartition(4).write.mode("append").parquet(inbox)
        counters = S.running_counters(V.review_shape(stream_of(spark, inbox, events.schema)))
        S.finish(S.upsert_counters(counters, out, run_folder(spark, "state")))
        assert len(tables.folders(spark, f"{out}/manifests")) == 2
    want = rollups.trend_weekly(V.review_shape(events.union(events)))
    assert sorted(map(tuple, S.read_counters(spark, out).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_a_micro_batch_writes_only_the_buckets_it_touches(spark):
    schema = "batch_id string, category string, review_date string, sentiment string"
    inbox, out, state = run_folder(spark, "inbox"), run_folder(spark, "out"), run_folder(spark, "state")

    def run(rows, buckets=16):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        S.finish(S.upsert_counters(S.running_counters(stream_of(spark, inbox, schema)), out, state, buckets=buckets))
        name = max(S._manifests(spark, out))[2]
        return name, S._manifest(spark, out, name)

    many = [("b", f"c{n}", "2031-05-09", "positive") for n in range(60)]
    first, before = run(many)
    assert len(before["versions"]) > 8 and before["buckets"] == 16
    second, after = run([("b", "c7", "2031-05-09", "negative")], buckets=5)
    assert after["buckets"] == 16 and second != first
    assert tables.folders(spark, f"{out}/data/{second}") == [f"bucket={b}" for b, v in after["versions"].items() if v == second]
    assert sum(v == second for v in after["versions"].values()) == 1 and sum(v == first for v in after["versions"].values()) == len(before["versions"]) - 1
    third, _ = run([("b", "new", "2031-05-09", "neutral")])
    assert sorted(tables.folders(spark, f"{out}/manifests")) == sorted([second, third])  # nothing piles up
    named = {(v, b) for m in (second, third) for b, v in S._manifest(spark, out, m)["versions"].items()}
    lying = {(v, int(b.split("=")[1])) for v in tables.folders(spark, f"{out}/data") for b in tables.folders(spark, f"{out}/data/{v}")}
    assert lying == named
    found = {r.category: (r.positive, r.neutral, r.negative) for r in S.read_counters(spark, out).collect()}
    assert len(found) == 61 and found["c7"] == (1, 0, 1) and found["new"] == (0, 1, 0) and found["c8"] == (1, 0, 0)


def test_counters_of_an_empty_stream(spark):
    schema = "batch_id string, category string, review_date string, sentiment string"
    inbox, out = run_folder(spark, "inbox"), run_folder(spark, "out")
    spark.createDataFrame([], schema).coalesce(1).write.parquet(inbox)
    S.finish(S.upsert_counters(S.running_counters(stream_of(spark, inbox, schema)), out, run_folder(spark, "state")))
    assert S.read_counters(spark, out).collect() == []


def test_reviews_are_stored_once_however_late(spark):
    schema = "review_id long, ts string"
    inbox, out, state = run_folder(spark, "inbox"), run_folder(spark, "out"), run_folder(spark, "state")
    parts = [[(1, "2024-06-01"), (1, "2024-06-01")], [(3, "2024-07-01")], [(2, "2020-01-01"), (3, "2024-07-01")]]
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        S.finish(S.store_once(stream_of(spark, inbox, schema), out, state))
    S.finish(S.store_once(stream_of(spark, inbox, schema), out, run_folder(spark, "state")))  # the checkpoint was lost
    assert sorted(r.review_id for r in S.read_once(spark, out).collect()) == [1, 2, 3]


def test_late_rows_count_and_weeks_start_on_monday(spark):
    first = [
        ("2025-01-13 00:00:00", "a", "positive"), ("2025-01-19 23:59:59", "a", "negative"), ("2025-01-20 00:00:00", "a", "neutral"),
        ("2025-01-12 23:59:59", "a", "positive"),
    ]
    later = [("2025-01-18 12:00:00", "a", "positive"), ("2025-01-10 00:00:00", "a", "positive"), ("2025-01-23 00:00:00", "a", "neutral")]
    schema = "ts timestamp, category string, sentiment string"
    inbox, out, state = run_folder(spark, "inbox"), run_folder(spark, "out"), run_folder(spark, "state")
    for rows in (first, later):
        frame = spark.createDataFrame(rows, "ts string, category string, sentiment string").withColumn("ts", F.col("ts").cast("timestamp"))
        frame.coalesce(1).write.mode("append").parquet(inbox)
        S.finish(S.upsert_counters(S.weekly_windows(spark.readStream.schema(schema).parquet(inbox)), out, state, S.WEEK_KEYS))
    got = {str(r["week_start"])[:10]: (r["positive"], r["neutral"], r["negative"]) for r in S.read_counters(spark, out).collect()}
    assert got == {"2025-01-06": (2, 0, 0), "2025-01-13": (2, 0, 1), "2025-01-20": (0, 2, 0)}


def test_progress(spark, folder):
    rows = V.reviews(spark, folder).select("review_id", "sentiment")
    inbox, progress = run_folder(spark, "inbox"), run_folder(spark, "progress")
    rows.repartition(5).write.parquet(inbox)
    S.finish(S.append_counted(stream_of(spark, inbox, rows.schema), run_folder(spark, "out"), run_folder(spark, "state"), progress))
    S.finish(S.append_counted(stream_of(spark, inbox, rows.schema), run_folder(spark, "out"), run_folder(spark, "state"), run_folder(spark, "other")))
    reports = S.progress_of(spark, progress).collect()
    assert sum(r.scored for r in reports) == rows.where("sentiment IS NOT NULL").count()
    assert sum(r.rows for r in reports) == rows.count() and len(reports) == 5


def test_same_row_same_key(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, "a")], "x string, y string")
    keys = [r[0] for r in df.select(S.review_key("x", "y")).collect()]
    assert keys[0] == keys[1] != keys[2]
