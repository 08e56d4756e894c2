"""Queries for reading, checking, mapping and writing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.operators import clustering, rollups, splits
from opinara.operators.corrections import correction_list
from opinara.operators.evaluation import neutral_misses
from opinara.plans import driver_views as V
from opinara.plans.catalog import query
from opinara.plans.oracle_views import with_views
from opinara.schema import CORRECTION_EXPORT, FALLBACK_SCOPE
from opinara.session import run_folder
from opinara.sources import tables, uploads
from opinara.sources.uploads import ColumnMapping


FILE_BYTES = 512 << 20  # of text in a file: one task has to write it


def _upload(spark, folder) -> str:
    """All documents as an uploaded folder of CSV files."""
    path = f"{run_folder(spark, 'upload')}/documents.csv"
    docs = V.documents(spark, folder)
    tables.write_csv(docs.select("doc_id", "text", F.col("lang").alias("category"), "source"), path)
    return path


@query(
    "s1_read_csv",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest, CAST(length(text) AS INTEGER) AS chars, lang AS category, source FROM documents",
)
def s1(spark, folder):
    rows = uploads.read_csv(spark, _upload(spark, folder))
    return rows.select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("chars"), "category", "source")


@query(
    "s1_one_file",
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang AS category, source FROM documents",
)
def s1_one_file(spark, folder):
    """One file that many tasks read, though its texts hold line breaks; more than ``FILE_BYTES`` of text make several such files."""
    path = run_folder(spark, "upload")
    docs = V.documents(spark, folder).select("doc_id", "text", F.col("lang").alias("category"), "source")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = -(-size // FILE_BYTES) or 1
    tables.write_csv(docs.coalesce(1) if files == 1 else docs.repartition(files), path)
    return uploads.read_csv(spark, path)


@query(
    "s2_check_upload",
    """SELECT 'mapped' AS upload, count(*) > 0 AS ok, CAST(NULL AS VARCHAR) AS error_code FROM documents
UNION ALL SELECT 'unknown_text', FALSE, 'MISSING_COLUMN' UNION ALL SELECT 'unknown_date', FALSE, 'MISSING_COLUMN'
UNION ALL SELECT 'wrong_type', FALSE, 'INVALID_FILE_TYPE'""",
)
def s2(spark, folder):
    path = _upload(spark, folder)
    cases = {
        "mapped": ColumnMapping("text", "category"),
        "unknown_text": ColumnMapping("body"),
        "unknown_date": ColumnMapping("text", date="day"),
    }
    checks = [uploads.check_upload(spark, path, m).select(F.lit(n).alias("upload"), "ok", "error_code") for n, m in cases.items()]
    no_csv = uploads.check_upload(spark, f"{path[:-4]}.txt", cases["mapped"])
    checks.append(no_csv.select(F.lit("wrong_type").alias("upload"), "ok", "error_code"))
    return reduce(DataFrame.unionByName, checks)


@query(
    "s3_map_columns",
    """SELECT md5(text) AS digest, lang AS category, '' AS review_date, CAST(doc_id AS VARCHAR) AS doc_id, source,
  CAST(n_chars AS VARCHAR) AS n_chars, 3 AS extras FROM documents""",
)
def s3(spark, folder):
    rows = uploads.map_columns(V.documents(spark, folder), ColumnMapping("text", "lang"))
    extra = [F.col("extra")[name].alias(name) for name in ("doc_id", "source", "n_chars")]
    return rows.select(F.md5("text").alias("digest"), "category", "review_date", *extra, F.size("extra").alias("extras"))


@query(
    "s4_detect_columns",
    """SELECT 'conversations' AS upload, 'text' AS text_column, '' AS category_column, count(*) AS rows,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations
UNION ALL SELECT 'documents', 'text', '', count(*), CAST(sum(length(text)) AS BIGINT) FROM documents
UNION ALL SELECT 'pages', 'page_id', '', count(*), CAST(sum(length(CAST(page_id AS VARCHAR))) AS BIGINT) FROM pages""",
)
def s4(spark, folder):
    parts = []
    for name in ("conversations", "documents", "pages"):
        rows = V.table(spark, folder, name)
        found = uploads.detect_columns(rows.columns)
        mapped = uploads.map_columns(rows, found)
        parts.append(
            mapped.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars")).select(
                F.lit(name).alias("upload"), F.lit(found.text).alias("text_column"),
                F.lit(found.category).alias("category_column"), "rows", "chars",
            )
        )
    return reduce(DataFrame.unionByName, parts)


@query("s5_preview", "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def s5(spark, folder):
    return uploads.preview(V.documents(spark, folder).select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query("s6_read_parquet", "SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def s6(spark, folder):
    docs = tables.read_table(spark, f"{folder}/documents.parquet")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


@query(
    "s7_content_ids",
    """WITH counted AS (SELECT text, lang, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT text, lang, source, n AS copies, TRUE AS told_apart FROM counted""",
)
def s7(spark, folder):
    """Per distinct row how many copies it has, and whether no id stands twice in the whole table."""
    rows = uploads.ensure_id(V.documents(spark, folder).select("text", "lang", "source"))
    per_id = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("text", "lang", "source")).alias("row"))
    per_row = per_id.select("row.*", "n").groupBy("text", "lang", "source")
    return per_row.agg(F.sum("n").alias("copies"), (F.max("n") == 1).alias("told_apart"))


REVIEW_FIELDS = "review_id, batch_id, category, review_date, sentiment, confidence_margin, issue_tag, cluster_source"


@query("s8_write_reviews", with_views(f"SELECT {REVIEW_FIELDS} FROM reviews", "reviews"))
def s8(spark, folder):
    path = run_folder(spark, "reviews")
    rows = V.reviews(spark, folder).select(*REVIEW_FIELDS.split(", "))
    tables.write_reviews(rows, path)
    tables.write_reviews(rows.filter("batch_id = 'b1'"), path)  # a re-run replaces its own batch only
    return tables.read_table(spark, path).select(*rows.columns)


@query("s9_write_rollups", with_views("SELECT * FROM trend", "trend"))
def s9(spark, folder):
    path = run_folder(spark, "rollups")
    built = rollups.split_rollups(rollups.all_rollups(V.reviews(spark, folder)))
    tables.write_rollups(built, path)
    tables.write_rollups({"trend_weekly": built["trend_weekly"].filter("batch_id = 'b2'")}, path)
    return tables.read_table(spark, f"{path}/trend_weekly").select(*built["trend_weekly"].columns)


@query(
    "s10_export_corrections",
    with_views(
        """SELECT text, label, manual_label, date, CAST(review_id AS VARCHAR) AS review_id, coalesce(batch_id, '') AS batch_id,
  session_id AS correction_source_session_id, round(confidence_margin, 4) AS confidence_margin FROM corrections""",
        "corrections",
    ),
)
def s10(spark, folder):
    path = run_folder(spark, "corrections")
    tables.export_corrections(V.corrections(spark, folder), path)
    back = uploads.read_csv(spark, path)
    assert tuple(back.columns) == CORRECTION_EXPORT
    return back.withColumn("confidence_margin", F.round(F.col("confidence_margin").cast("double"), 4))


@query("s11_write_splits", with_views("SELECT id, label, split FROM split3", "split3"))
def s11(spark, folder):
    path = run_folder(spark, "splits")
    tables.write_splits(splits.stratified_split(V.dataset(spark, folder)).select("id", "label", "split"), path)
    return tables.read_table(spark, path).select("id", "label", "split")


@query(
    "s12_worksheet_csv",
    with_views(
        """SELECT CAST(id AS VARCHAR) AS id, category, round(lead, 6) AS lead FROM predictions
WHERE y = 1 AND pred <> 1 AND lead > 0.15""",
        "predictions",
    ),
)
def s12(spark, folder):
    path = run_folder(spark, "misses")
    misses = neutral_misses(V.predictions(spark, folder)).filter("bucket = 'confident'")
    tables.write_csv(misses.select("id", "category", "lead"), path)
    back = uploads.read_csv(spark, path)
    return back.withColumn("lead", F.round(F.col("lead").cast("double"), 6))


@query(
    "s13_model_tables",
    with_views(
        """SELECT scope, cluster_id, 'issue_' || CAST(cluster_id AS VARCHAR) AS name, 0.9E0 AS threshold, CAST(len(centroid) AS INTEGER) AS dims,
  round(list_sum(centroid), 6) AS total FROM means WHERE scope = 'cross_category_fallback'""",
        "means",
    ),
)
def s13(spark, folder):
    path = run_folder(spark, "centroids")
    means = clustering.label_centroids(V.vectors(spark, folder), "cluster_id", F.lit(FALLBACK_SCOPE), 0.9)
    tables.write_centroids(means, path)
    total = F.aggregate("centroid", F.lit(0.0), lambda acc, x: acc + x)
    return tables.read_centroids(spark, path).select(
        "scope", "cluster_id", "name", "threshold", F.size("centroid").alias("dims"), F.round(total, 6).alias("total")
    )


@query("s14_scan_corrections", with_views("SELECT * FROM corrections", "corrections"))
def s14(spark, folder):
    return correction_list(V.corrections(spark, folder))


