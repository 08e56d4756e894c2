import numpy as np
import pytest
from pyspark.sql import functions as F

from opinara.operators.scoring import fixed_weights, text_vectoriser, vectorise
from opinara.plans import enrichment
from opinara.schema import CENTROIDS, FALLBACK_SCOPE, REVIEWS
from opinara.sources import tables, uploads
from opinara.sources.uploads import ColumnMapping
from opinara.session import run_folder

FULL = 'opinion,kind,day\nThe kettle leaks,Kitchen,2031-05-09\nLamp glows nicely,Light,2031-05-10\n'


def write(tmp_path, name, content):
    path = tmp_path / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


@pytest.mark.parametrize(
    "name, content, mapping, code",
    [
        ("full.csv", FULL, ColumnMapping("opinion", "kind", "day"), None),
        ("one.csv", "words\nA sturdy chair\n", ColumnMapping("words"), None),
        ("UPPER.CSV", "words\nA sturdy chair\n", ColumnMapping("words"), None),
        ("full.txt", FULL, ColumnMapping("opinion"), "INVALID_FILE_TYPE"),
        ("empty.csv", "", ColumnMapping("t"), "EMPTY_FILE"),
        ("blank.csv", " \n \n", ColumnMapping("t"), "EMPTY_FILE"),
        ("latin.csv", "t\ncaf\xe9\n".encode("latin-1"), ColumnMapping("t"), "INVALID_ENCODING"),
        ("utf8.csv", "t\ncafé\n", ColumnMapping("t"), None),
        ("missing.csv", FULL, ColumnMapping("text"), "MISSING_COLUMN"),
        ("category.csv", FULL, ColumnMapping("opinion", "sort"), "MISSING_COLUMN"),
        ("date.csv", FULL, ColumnMapping("opinion", "kind", "date"), "MISSING_COLUMN"),
        ("header.csv", "opinion,kind\n", ColumnMapping("opinion"), "EMPTY_CSV"),
    ],
)
def test_checks(spark, tmp_path, name, content, mapping, code):
    row = uploads.check_upload(spark, write(tmp_path, name, content), mapping).first()
    assert (row["ok"], row["error_code"]) == (code is None, code)


def test_missing_file_counts_as_empty(spark, tmp_path):
    assert uploads.check_upload(spark, str(tmp_path / "no.csv"), ColumnMapping("t")).first()["error_code"] == "EMPTY_FILE"


def test_csv_round_trip(spark, tmp_path):
    texts = ["plain", 'says "hi", ok', "two\nlines", "", " spaced ", "back\\slash", '"', "a,b", "NULL", "été"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, t string")
    path = str(tmp_path / "x.csv")
    tables.write_csv(df.repartition(2), path)
    back = {r["id"]: r["t"] for r in uploads.read_csv(spark, path).collect()}
    assert [back[str(i)] for i in range(len(texts))] == texts


def test_detection():
    assert uploads.detect_columns(["ID", "Review", "Created_At", "Tag"]) == ColumnMapping("Review", "Tag", "Created_At")
    assert uploads.detect_columns(["body", "sentiment"]) == ColumnMapping("sentiment")
    assert uploads.detect_columns(["body", "x"]) == ColumnMapping("body")


def test_mapping(spark):
    df = spark.createDataFrame([("t", "c", "4")], "text string, `my.cat` string, rating string")
    row = uploads.map_columns(df, ColumnMapping("text", "my.cat")).first()
    assert (row["text"], row["category"], row["review_date"], row["extra"]) == ("t", "c", "", {"rating": "4"})
    bare = uploads.map_columns(df.select("text"), ColumnMapping("text")).first()
    assert bare["extra"] is None and bare["category"] == ""


def test_content_ids_with_many_copies(spark, monkeypatch):
    monkeypatch.setattr(uploads, "COPIES_PER_CHUNK", 10)
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("t"), F.lit(None).cast("string").alias("u"))
    first = uploads.with_content_ids(df).collect()
    again = uploads.with_content_ids(df.repartition(9)).collect()
    assert len({r["id"] for r in first}) == 300 and sum(r["t"] == "copy" for r in first) == 100
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)
    assert uploads.ensure_id(spark.range(3)).columns == ["id"]


def test_export_has_the_agreed_columns(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "r1", "b", "t\n\"q\"", "negative", "positive", "2025-01-01", "s", 0.25, "more")],
                                 "correction_id string, review_id string, batch_id string, text string, label string, "
                                 "manual_label string, date string, session_id string, confidence_margin double, other string")  # fmt: skip
    path = str(tmp_path / "out.csv")
    tables.export_corrections(rows, path)
    back = uploads.read_csv(spark, path)
    assert back.columns == ["text", "label", "manual_label", "date", "review_id", "batch_id", "correction_source_session_id", "confidence_margin"]
    assert back.first()["text"] == 't\n"q"' and back.first()["confidence_margin"] == "0.25"


def test_blank_centroid_names_are_refused(spark, tmp_path):
    table = spark.createDataFrame([("a", 0, " ", 0.7, [1.0])], CENTROIDS)
    with pytest.raises(ValueError):
        tables.write_centroids(table, str(tmp_path / "c"))


def test_enrichment_end_to_end_and_again(spark, tmp_path):
    csv = "text,category,date,rating\n" + "".join(f"Good item number {i}. it works,{'AB'[i % 2]},2025-01-{15 + i % 10},{i % 5}\n" for i in range(40))
    upload = uploads.read_csv(spark, write(tmp_path, "up.csv", csv + "<br>,A,n/a,1\n"))
    mapping = ColumnMapping("text", "category", "date")
    prepared = enrichment.prepare(upload, mapping, "batch-1")
    assert prepared.select("review_id").distinct().count() == 41
    assert prepared.filter("text = '<br>'").first()["clean_text"] == "<br>"
    model = text_vectoriser(prepared, "clean_text", width=16)
    ready = vectorise(prepared, model, "clean_text")
    centroids = spark.createDataFrame([(FALLBACK_SCOPE, 0, "thing", None, [0.0] * 16)], CENTROIDS)
    reviews = enrichment.enrich(ready, fixed_weights(16), centroids)
    assert reviews.columns == REVIEWS.fieldNames()
    out = run_folder(spark, "enrichment-test")
    for _ in range(2):
        stored = enrichment.store(reviews, out)
    trend = tables.read_table(spark, f"{out}/trend_weekly")
    total = F.sum(F.col("positive") + F.col("neutral") + F.col("negative"))
    assert trend.agg(total).first()[0] == 41 and trend.filter("week = 'unknown'").count() == 1
    written = tables.read_table(spark, f"{out}/reviews")
    assert written.count() == 41 and written.filter("extra['rating'] IS NULL").isEmpty()
    negatives = written.filter("sentiment = 'negative'").count()
    assert (stored["issue_weekly"].agg(F.sum("count")).first()[0] or 0) == negatives
    assert np.isclose(written.agg(F.avg(F.col("prob_negative") + F.col("prob_neutral") + F.col("prob_positive"))).first()[0], 1.0)


def test_uploads_with_any_column_names(spark):
    rows = [("r1", "b9", "1", "2", "fine pan"), ("r1", "b9", "1", "2", "fine pan"), ("r2", "b9", "1", "2", "bad lid")]
    upload = spark.createDataFrame(rows, "review_id string, batch_id string, _n string, _chunk string, words string")
    prepared = enrichment.prepare(upload, ColumnMapping("words"), "batch-7")
    found = sorted((r.text, r.batch_id, r.extra["review_id"], r.extra["batch_id"], r.extra["_n"]) for r in prepared.collect())
    assert found == [("bad lid", "batch-7", "r2", "b9", "1")] + [("fine pan", "batch-7", "r1", "b9", "1")] * 2
    assert len({r.review_id for r in prepared.collect()}) == 3


def test_a_batch_without_complaints_leaves_no_old_counts(spark, tmp_path):
    def table(*rows):
        return {"issues": spark.createDataFrame(list(rows), "batch_id string, issue_tag string, count long")}

    path = str(tmp_path / "out")
    tables.write_rollups(table(("a b", "t", 3), ("c", "t", 4)), path, ["a b", "c"])
    tables.write_rollups({"issues": table(("x", "t", 1))["issues"].limit(0)}, path, ["a b"])
    assert [(r.batch_id, r["count"]) for r in spark.read.parquet(f"{path}/issues").collect()] == [("c", 4)]


def test_batch_record(spark, tmp_path):
    from datetime import datetime

    path = str(tmp_path / "out")
    upload = spark.createDataFrame([("a", "x"), ("b", "y")], "words string, kind string")
    stored = spark.createDataFrame([("r1", "b1"), ("r2", "b1"), ("r3", "b2")], "review_id string, batch_id string")
    tables.write_by(stored, f"{path}/reviews", "batch_id")
    mapping = ColumnMapping("words", "kind")
    start, stop = datetime(2031, 5, 9, 10, 0, 0), datetime(2031, 5, 9, 10, 0, 2)
    row = enrichment.record_batch(upload, mapping, "b1", path, "up.csv", start, stop).first()
    assert (row.total_reviews, row.processed_count, row.status, row.processing_duration_seconds) == (2, 2, "done", 2.0)
    assert (row.column_mapping, row.csv_columns) == ({"text": "words", "category": "kind"}, ["words", "kind"])
    assert enrichment.record_batch(upload, mapping, "b2", path, "up.csv", start, stop).first().status == "failed"
    assert sorted(r.batch_id for r in spark.read.parquet(f"{path}/batches").collect()) == ["b1", "b2"]


def test_one_file_is_written_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    from opinara.plans import catalog_sources

    rows = [(k, 'said "so",\nthen left ' + "x" * 100, "en", "web", 120) for k in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    paths, write = [], catalog_sources.tables.write_csv
    monkeypatch.setattr(catalog_sources.tables, "write_csv", lambda df, path: (paths.append(path), write(df, path)))
    one = sorted(map(tuple, catalog_sources.s1_one_file(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(catalog_sources, "FILE_BYTES", 1000)
    many = sorted(map(tuple, catalog_sources.s1_one_file(spark, str(tmp_path)).collect()))
    files = [spark.read.text(path).select("_metadata.file_path").distinct().count() for path in paths]
    assert one == many and len(one) == 50 and files[0] == 1 and files[1] > 3
