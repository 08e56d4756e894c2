"""Queries that run a stream over everything available and return the finished table."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions.cleaning import clean_or_raw
from opinara.operators import clustering, scoring
from opinara.plans import driver_views as V
from opinara.plans import enrichment
from opinara.plans.catalog import query
from opinara.plans.oracle_views import SENTIMENT_SUMS, with_views
from opinara.session import cut, run_folder, spread
from opinara.sources import tables
from opinara.sources.uploads import ColumnMapping, map_columns
from opinara.streaming import reviews as S

WIDTH = 64


def _event_stream(spark, folder, files: int = 4, copies: int = 1, per_trigger: int = 0):
    """The events table as a folder of files that a stream reads."""
    events = V.table(spark, folder, "events")
    path = run_folder(spark, "events")
    for _ in range(copies):
        events.repartition(files).write.mode("append").parquet(path)
    reader = spark.readStream.schema(events.schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


@query(
    "t1_enriched_stream",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang AS category, CAST(length(text) AS INTEGER) AS chars, TRUE AS scored FROM documents",
)
def t1(spark, folder):
    docs = spread(V.documents(spark, folder).select("doc_id", "text", F.col("lang").alias("category")))
    inbox, out = run_folder(spark, "inbox"), run_folder(spark, "enriched")
    tables.write_csv(docs, inbox)
    cleaned_docs = cut(scoring.with_terms(docs.select(clean_or_raw(F.col("text")).alias("text")), width=WIDTH))
    encoder = scoring.text_vectoriser(cleaned_docs, width=WIDTH)
    vectors = cut(scoring.vectorise(cleaned_docs, encoder).select("features"))
    model = clustering.fit_global(vectors, k=5, max_iter=5)
    centroids = clustering.centroid_frame(spark, model)
    arriving = map_columns(S.csv_stream(spark, inbox, docs.columns), ColumnMapping("text", "category"))
    cleaned = arriving.withColumns({"raw": F.col("text"), "text": clean_or_raw(F.col("text"))})
    scored = scoring.score_reviews(scoring.vectorise(cleaned, encoder), scoring.fixed_weights(WIDTH), centroids)
    S.finish(S.append_to(scored.drop("features"), out, run_folder(spark, "state")))
    done = tables.read_table(spark, out)
    return done.select(
        F.col("extra")["doc_id"].alias("doc_id"), "category", F.length("raw").alias("chars"), F.col("sentiment").isNotNull().alias("scored")
    )


@query(
    "e1_enriched_batch",
    """SELECT CAST(count(*) AS BIGINT) AS reviews, CAST(count(*) AS BIGINT) AS trend_total, CAST(count(*) AS BIGINT) AS category_total,
  CAST(sum(length(text)) AS BIGINT) AS chars, TRUE AS issues_match FROM documents""",
)
def e1(spark, folder):
    """Upload, clean, vectorise, score, store, roll up; the stored tables must agree with each other."""
    upload = V.documents(spark, folder).select("text", F.col("lang").alias("category"), "source")
    prepared = cut(enrichment.prepare(upload, ColumnMapping("text", "category"), "batch-1"))
    encoder = scoring.text_vectoriser(prepared, "clean_text", width=WIDTH)
    ready = cut(scoring.vectorise(prepared, encoder, "clean_text"))
    centroids = clustering.centroid_frame(spark, clustering.fit_global(ready.select("features"), k=5, max_iter=5))
    out = run_folder(spark, "batch")
    tables_out = enrichment.store(enrichment.enrich(ready, scoring.fixed_weights(WIDTH), centroids), out)
    written = tables.read_table(spark, f"{out}/reviews")
    negatives = F.count_if(F.col("sentiment") == "negative")
    counted = written.agg(F.count(F.lit(1)).alias("reviews"), F.sum(F.length("text")).alias("chars"), negatives.alias("negatives"))
    known = F.col("positive") + F.col("neutral") + F.col("negative")

    def total(name):
        return tables_out[name].agg(F.sum(known)).first()[0]

    issues = tables_out["issue_weekly"].agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    return counted.select(
        "reviews",
        F.lit(total("trend_weekly")).alias("trend_total"),
        F.lit(total("category_totals")).alias("category_total"),
        "chars",
        (F.col("negatives") == F.lit(issues)).alias("issues_match"),
    )


@query("t2_running_counters", with_views("SELECT * FROM trend", "trend"))
def t2(spark, folder):
    out = run_folder(spark, "counters")
    stream = V.review_shape(_event_stream(spark, folder, files=3, per_trigger=1))
    S.finish(S.upsert_counters(S.running_counters(stream), out, run_folder(spark, "state")))
    return S.read_counters(spark, out)


@query(
    "t3_weekly_windows",
    with_views(
        f"SELECT date_trunc('week', ts) AS week_start, category, {SENTIMENT_SUMS} FROM reviews GROUP BY ALL",
        "reviews",
    ),
)
def t3(spark, folder):
    out = run_folder(spark, "weeks")
    stream = V.review_shape(_event_stream(spark, folder, per_trigger=2)).withColumn("ts", S.utc_instant(F.col("ts")))
    S.finish(S.upsert_counters(S.weekly_windows(stream), out, run_folder(spark, "state"), S.WEEK_KEYS))
    return S.read_counters(spark, out).withColumn("week_start", S.utc_wall_clock(F.col("week_start")))


@query("t4_once_per_review", with_views("SELECT review_id, category, sentiment FROM reviews", "reviews"))
def t4(spark, folder):
    out = run_folder(spark, "once")
    stream = V.review_shape(_event_stream(spark, folder, files=2, copies=2, per_trigger=2))
    S.finish(S.store_once(stream.select("review_id", "category", "sentiment"), out, run_folder(spark, "state")))
    return S.read_once(spark, out)


@query("t5_progress", with_views("SELECT count(*) AS rows, count(sentiment) AS scored FROM reviews", "reviews"))
def t5(spark, folder):
    stream = V.review_shape(_event_stream(spark, folder, files=2, per_trigger=1)).select("review_id", "sentiment")
    progress = run_folder(spark, "progress")
    S.finish(S.append_counted(stream, run_folder(spark, "seen"), run_folder(spark, "state"), progress))
    return S.progress_of(spark, progress).agg(F.sum("rows").alias("rows"), F.sum("scored").alias("scored"))
