"""Queries for corrections, audits, id sets, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.operators import corrections, curation, ranking, splits
from opinara.plans import driver_views as V
from opinara.plans import retraining
from opinara.plans.catalog import query
from opinara.plans.oracle_views import with_views

VOTE_ORDER = ["date", "vote_id"]


def _routed(spark, folder):
    return retraining.verdicts(V.votes(spark, folder), V.known_ids(spark, folder), VOTE_ORDER)


def _ballots(spark, folder):
    flagged = corrections.flag_sessions(V.votes(spark, folder))
    return corrections.ballots(flagged, VOTE_ORDER, ["confidence_margin"])


# --- listings and predicates ---


@query(
    "f11_corrections_by_label",
    with_views("SELECT correction_id, label, manual_label FROM corrections WHERE label = 'negative' AND manual_label = 'positive'", "corrections"),
)
def f11(spark, folder):
    rows = corrections.correction_list(V.corrections(spark, folder), "negative", "positive")
    return rows.select("correction_id", "label", "manual_label")


@query(
    "f14_invalid_labels",
    with_views("SELECT id, corrected_label FROM audit WHERE corrected_label NOT IN ('negative', 'neutral', 'positive')", "audit"),
)
def f14(spark, folder):
    return corrections.invalid_labels(V.audit(spark, folder), "corrected_label").select("id", "corrected_label")


@query(
    "f15_upweight_targets",
    with_views(
        """SELECT DISTINCT id FROM full_registry
WHERE audit_status = 'true_model_wrong_negative' OR contains(notes, 'mixed_but_neutral')""",
        "full_registry",
    ),
)
def f15(spark, folder):
    return curation.upweight_targets(V.full_registry(spark, folder))


@query(
    "f16_bucket_prefix",
    with_views("SELECT id, primary_bucket FROM reaudit WHERE starts_with(primary_bucket, 'true_model_wrong')", "reaudit"),
)
def f16(spark, folder):
    rows = V.reaudit(spark, folder)
    return rows.filter(F.col("primary_bucket").startswith("true_model_wrong")).select("id", "primary_bucket")


@query(
    "j1_corrections_with_review",
    with_views(
        """SELECT c.correction_id, c.review_id, round(coalesce(r.confidence_margin, c.confidence_margin), 4) AS confidence_margin, r.category
FROM corrections c LEFT JOIN (SELECT * FROM reviews WHERE category NOT IN ('purchase', 'view')) r ON r.review_id = c.review_id""",
        "corrections", "reviews",
    ),
)
def j1(spark, folder):
    known = V.reviews(spark, folder).filter("category NOT IN ('purchase', 'view')")
    rows = corrections.with_review_fields(V.corrections(spark, folder), known)
    margin = F.round("confidence_margin", 4).alias("confidence_margin")
    return rows.select("correction_id", "review_id", margin, "category")


@query(
    "a12_correction_totals",
    with_views("SELECT count(*) AS total, count(DISTINCT nullif(batch_id, '')) AS batch_count FROM corrections", "corrections"),
)
def a12(spark, folder):
    return corrections.correction_totals(V.corrections(spark, folder))


@query(
    "w4_corrections_sorted",
    with_views(
        "SELECT correction_id, manual_label, date FROM corrections", "corrections"
    ),
)
def w4(spark, folder):
    rows = corrections.correction_list(V.corrections(spark, folder), sort_by="manual_label", ascending=False)
    return rows.select("correction_id", "manual_label", "date")


# --- trust gates ---


@query("w7_session_dominance", with_views("SELECT session_id, votes, round(dominant_ratio, 6) AS dominant_ratio FROM dominance", "dominance"))
def w7(spark, folder):
    rows = corrections.session_dominance(V.votes(spark, folder))
    return rows.withColumn("dominant_ratio", F.round("dominant_ratio", 6))


@query("c3_suspicious_sessions", with_views("SELECT session_id FROM flagged", "flagged"))
def c3(spark, folder):
    return corrections.suspicious_sessions(V.votes(spark, folder)).select("session_id")


@query("a25_sessions_per_review", with_views("SELECT review_id, count(DISTINCT session_id) AS sessions FROM votes GROUP BY review_id", "votes"))
def a25(spark, folder):
    return corrections.sessions_per_review(V.votes(spark, folder))


@query(
    "c2_volume_gate",
    with_views(
        """SELECT (SELECT count(*) FROM votes) AS loaded, count(*) AS remaining,
  (SELECT count(*) FROM votes) >= 10 AS enough_loaded, count(*) >= 10 AS enough_remaining FROM kept_votes""",
        "votes", "kept_votes",
    ),
)
def c2(spark, folder):
    return corrections.volume_gate(V.votes(spark, folder))


@query("w6_majority_votes", with_views("SELECT review_id, votes, majority, tie FROM ballots WHERE votes > 0 AND NOT tie", "ballots"))
def w6(spark, folder):
    return _ballots(spark, folder).filter("votes > 0 AND NOT tie").select("review_id", "votes", "majority", "tie")


@query(
    "w8_first_values",
    with_views("SELECT review_id, round(confidence_margin, 4) AS confidence_margin FROM ballots WHERE votes > 0", "ballots"),
)
def w8(spark, folder):
    kept = _ballots(spark, folder).filter("votes > 0")
    return kept.select("review_id", F.round("confidence_margin", 4).alias("confidence_margin"))


@query("c4_deferred_reviews", with_views("SELECT review_id, sessions FROM routed WHERE status = 'deferred_volume'", "routed"))
def c4(spark, folder):
    return _routed(spark, folder).filter("status = 'deferred_volume'").select("review_id", "sessions")


@query("c5_tied_reviews", with_views("SELECT review_id, votes FROM routed WHERE status = 'excluded_tie'", "routed"))
def c5(spark, folder):
    return _routed(spark, folder).filter("status = 'excluded_tie'").select("review_id", "votes")


@query(
    "c6_routed_corrections",
    with_views(
        "SELECT review_id, status, CASE WHEN status IN ('applied', 'applied_flagged', 'new_text') THEN majority END AS new_label FROM routed", "routed"
    ),
)
def c6(spark, folder):
    return _routed(spark, folder).select("review_id", "status", "new_label")


@query("c7_trust_summary", with_views("SELECT status, count(*) AS reviews FROM routed GROUP BY status", "routed"))
def c7(spark, folder):
    return corrections.trust_summary(_routed(spark, folder))


@query(
    "u6_new_training_rows",
    with_views("SELECT 'new_' || CAST(review_id AS VARCHAR) AS id, majority AS label, 'train' AS split FROM routed WHERE status = 'new_text'", "routed"),
)
def u6(spark, folder):
    return corrections.new_training_rows(_routed(spark, folder))


@query(
    "c6_relabelled_training_rows",
    with_views(
        """SELECT d.id, CASE WHEN d.split = 'train' AND r.status IN ('applied', 'applied_flagged') THEN r.majority ELSE d.label END AS label,
  CASE WHEN r.status IS NULL OR r.status NOT IN ('applied', 'applied_flagged') THEN 'untouched'
       WHEN d.split = 'train' THEN 'relabelled' ELSE 'blocked' END AS outcome
FROM split3 d LEFT JOIN routed r ON r.review_id = d.id""",
        "split3", "routed",
    ),
)
def c6_relabel(spark, folder):
    rows = splits.stratified_split(V.dataset(spark, folder)).select(F.col("id").alias("review_id"), "label", "split")
    done = corrections.apply_verdicts(rows, _routed(spark, folder))
    return done.select(F.col("review_id").alias("id"), "label", "outcome")


MERGED = """known AS (SELECT * FROM reviews WHERE category NOT IN ('purchase', 'view')),
judged AS (SELECT v.review_id, coalesce(v.session_id, '') AS session_id, v.manual_label, v.date, k.batch_id, k.sentiment, k.confidence_margin,
    CASE WHEN k.review_id IS NULL THEN 'NOT_FOUND' WHEN v.manual_label = k.sentiment THEN 'NO_OP' END AS reason
    FROM votes v LEFT JOIN known k ON k.review_id = v.review_id),
latest AS (SELECT review_id, session_id, batch_id, sentiment, arg_max(struct_pack(m := manual_label, d := date),
    struct_pack(d := date, m := manual_label)) AS v FROM judged WHERE reason IS NULL GROUP BY ALL),
existing AS (SELECT * FROM corrections WHERE confidence_margin < 0.5),
by_session AS (SELECT review_id, session_id, arg_min(correction_id, struct_pack(d := date, c := correction_id)) AS cid
    FROM existing WHERE session_id <> '' GROUP BY ALL),
by_review AS (SELECT review_id, arg_min(correction_id, struct_pack(d := date, c := correction_id)) AS cid FROM existing GROUP BY review_id),
fresh AS (SELECT j.*, coalesce(CASE WHEN j.session_id <> '' THEN s.cid ELSE r.cid END,
      md5(CAST(j.review_id AS VARCHAR) || ':' || j.session_id)) AS correction_id
    FROM latest j LEFT JOIN by_session s ON s.review_id = j.review_id AND s.session_id = j.session_id
    LEFT JOIN by_review r ON r.review_id = j.review_id),
winners AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY correction_id ORDER BY v.d DESC, session_id DESC) AS place FROM fresh)
    WHERE place = 1)"""


def _merged_sql(body: str) -> str:
    head, _ = with_views("SELECT 1", "votes", "corrections", "reviews").rsplit("\n", 1)
    return f"{head},\n{MERGED}\n{body}"


def _merge(spark, folder):
    incoming = V.votes(spark, folder).select("review_id", "session_id", "manual_label", "date")
    existing = V.corrections(spark, folder).filter("confidence_margin < 0.5")
    known = V.reviews(spark, folder).filter("category NOT IN ('purchase', 'view')").withColumn("text", F.lit("text"))
    return corrections.merge_corrections(incoming, existing, known)


@query(
    "c1_merged_corrections",
    _merged_sql(
        """SELECT correction_id, review_id, session_id, label, manual_label, date, batch_id FROM existing
WHERE correction_id NOT IN (SELECT correction_id FROM winners)
UNION ALL SELECT correction_id, review_id, session_id, sentiment, v.m, v.d, batch_id FROM winners"""
    ),
)
def c1(spark, folder):
    merged, _ = _merge(spark, folder)
    return merged.select("correction_id", "review_id", "session_id", "label", "manual_label", "date", "batch_id")


@query(
    "c1_rejected_corrections",
    _merged_sql("SELECT review_id, session_id, manual_label, date, reason FROM judged WHERE reason IS NOT NULL"),
)
def c1_rejects(spark, folder):
    _, rejects = _merge(spark, folder)
    return rejects


# --- audits ---


@query("c8_audit_violations", with_views("SELECT id, rule FROM audit_violations", "audit_violations"))
def c8(spark, folder):
    return curation.audit_violations(V.audit(spark, folder))


@query("c8_reaudit_violations", with_views("SELECT id, rule FROM reaudit_violations", "reaudit_violations"))
def c8_reaudit(spark, folder):
    return curation.reaudit_violations(V.reaudit(spark, folder))


@query("a23_bucket_counts", with_views("SELECT primary_bucket AS bucket, count(*) AS count FROM reaudit GROUP BY primary_bucket", "reaudit"))
def a23(spark, folder):
    return curation.bucket_counts(V.reaudit(spark, folder), "primary_bucket")


MERGED_LABELS = """SELECT d.id, d.label AS original_label, coalesce(CASE WHEN a.manual_label = 'mislabel' THEN a.corrected_label END, d.label) AS label
FROM dataset d LEFT JOIN clean_audit a ON a.id = d.id"""


def _merged_labels(spark, folder):
    return curation.merge_labels(V.dataset(spark, folder), curation.audit_changes(V.clean_audit(spark, folder)))


@query("c9_merged_labels", with_views(MERGED_LABELS, "dataset", "clean_audit"))
def c9(spark, folder):
    return _merged_labels(spark, folder).select("id", "original_label", "label")


@query(
    "j2_reaudited_labels",
    with_views(
        """SELECT d.id, coalesce(CASE WHEN starts_with(r.primary_bucket, 'mislabel_') THEN substr(r.primary_bucket, 10) END, d.label) AS label
FROM dataset d LEFT JOIN clean_reaudit r ON r.id = d.id""",
        "dataset", "clean_reaudit",
    ),
)
def j2(spark, folder):
    changes = curation.reaudit_changes(V.clean_reaudit(spark, folder))
    return curation.apply_labels(V.dataset(spark, folder), changes).select("id", "label")


@query("j3_original_label_kept", with_views("SELECT id, label AS original_label FROM dataset", "dataset"))
def j3(spark, folder):
    once = _merged_labels(spark, folder)
    twice = curation.merge_labels(once, curation.reaudit_changes(V.clean_reaudit(spark, folder)))
    return twice.select("id", "original_label")


@query("j4_not_reviewed", with_views("SELECT id, label FROM dataset WHERE id NOT IN (SELECT id FROM full_registry)", "dataset", "full_registry"))
def j4(spark, folder):
    return curation.without_ids(V.dataset(spark, folder).select("id", "label"), V.full_registry(spark, folder))


@query("j5_reviewed", with_views("SELECT id, label FROM dataset WHERE id IN (SELECT id FROM full_registry)", "dataset", "full_registry"))
def j5(spark, folder):
    return curation.with_ids(V.dataset(spark, folder).select("id", "label"), V.full_registry(spark, folder))


@query(
    "j6_real_changes",
    with_views(
        f"SELECT id, original_label AS label_before, label AS label_after FROM ({MERGED_LABELS}) WHERE original_label <> label", "dataset", "clean_audit"
    ),
)
def j6(spark, folder):
    return curation.real_changes(V.dataset(spark, folder), _merged_labels(spark, folder))


@query("j7_cluster_metadata", "SELECT e.vec_id AS id, e.label AS cluster_id, d.lang, d.source FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id")
def j7(spark, folder):
    meta = V.documents(spark, folder).select(F.col("doc_id").alias("id"), "lang", "source")
    return V.vectors(spark, folder).select("id", "cluster_id").join(meta, "id")


@query(
    "j10_alignment",
    """WITH ids AS (SELECT doc_id AS id FROM documents UNION SELECT vec_id FROM embeddings UNION SELECT doc_id FROM labels)
SELECT 'documents' AS "table", count(*) FILTER (id NOT IN (SELECT doc_id FROM documents)) AS missing, CAST(0 AS BIGINT) AS repeated FROM ids
UNION ALL SELECT 'embeddings', count(*) FILTER (id NOT IN (SELECT vec_id FROM embeddings)), 0 FROM ids
UNION ALL SELECT 'labels', count(*) FILTER (id NOT IN (SELECT doc_id FROM labels)), 0 FROM ids""",
)
def j10(spark, folder):
    docs = V.documents(spark, folder).select(F.col("doc_id").alias("id"))
    quality = V.table(spark, folder, "labels").select(F.col("doc_id").alias("id"))
    return curation.alignment(documents=docs, embeddings=V.vectors(spark, folder), labels=quality)


REGISTRY_ROWS = "SELECT id, round, sampling_strategy, old_label, manual_label, audit_status, notes FROM full_registry"


@query("c10_registry", with_views(REGISTRY_ROWS, "full_registry"))
def c10(spark, folder):
    return V.full_registry(spark, folder)


# --- id sets ---


@query("u1_id_union", with_views("SELECT id FROM full_registry UNION SELECT id FROM frozen", "full_registry", "frozen"))
def u1(spark, folder):
    frozen = splits.freeze_hard_cases(V.clean_reaudit(spark, folder))
    return curation.id_union(V.full_registry(spark, folder), frozen)


@query("u2_leaks", with_views("SELECT id FROM full_registry INTERSECT SELECT id FROM split3 WHERE split = 'test'", "full_registry", "split3"))
def u2(spark, folder):
    test = splits.stratified_split(V.dataset(spark, folder)).filter("split = 'test'")
    return curation.leaks(V.full_registry(spark, folder), test)


@query("u3_id_difference", with_views("SELECT id FROM full_registry EXCEPT SELECT id FROM frozen", "full_registry", "frozen"))
def u3(spark, folder):
    frozen = splits.freeze_hard_cases(V.clean_reaudit(spark, folder))
    return curation.id_difference(V.full_registry(spark, folder), frozen)


@query(
    "u4_append_new",
    with_views(
        """SELECT id, round FROM registry UNION ALL
SELECT id, 'confidence_audit' FROM clean_audit WHERE id NOT IN (SELECT id FROM registry)""",
        "registry", "clean_audit",
    ),
)
def u4(spark, folder):
    rows = curation.audit_registry_rows(V.clean_audit(spark, folder))
    return curation.append_new(V.registry(spark, folder), rows).select("id", "round")


@query("u5_append_distinct", with_views("SELECT id FROM registry UNION SELECT id FROM clean_reaudit", "registry", "clean_reaudit"))
def u5(spark, folder):
    return curation.append_distinct(V.registry(spark, folder), V.clean_reaudit(spark, folder))


@query("u8_distinct_ids", with_views("SELECT DISTINCT review_id FROM corrections", "corrections"))
def u8(spark, folder):
    return V.corrections(spark, folder).select("review_id").distinct()


# --- splits and samples ---


@query("c11_frozen_cases", with_views("SELECT id, primary_bucket FROM frozen", "frozen"))
def c11(spark, folder):
    return splits.freeze_hard_cases(V.clean_reaudit(spark, folder)).select("id", "primary_bucket")


@query("c12_stratified_split", with_views("SELECT * FROM split3", "split3"))
def c12(spark, folder):
    return splits.stratified_split(V.dataset(spark, folder))


def _split4(spark, folder):
    frozen = splits.freeze_hard_cases(V.clean_reaudit(spark, folder))
    return splits.resplit_unreviewed(V.dataset(spark, folder), V.full_registry(spark, folder), frozen)


@query("c13_resplit_unreviewed", with_views("SELECT * FROM split4", "split4"))
def c13(spark, folder):
    return _split4(spark, folder)


@query(
    "c14_split_report",
    with_views(
        """SELECT split, label, count(*) AS count, round(count(*) * 100.0E0 / sum(count(*)) OVER (PARTITION BY split), 4) AS pct_of_split,
  round(count(*) * 100.0E0 / sum(count(*)) OVER (), 4) AS pct_of_all FROM split4 GROUP BY split, label""",
        "split4",
    ),
)
def c14(spark, folder):
    return splits.split_report(_split4(spark, folder))


@query("c14_leak_counts", with_views(
    """SELECT count(*) FILTER (split = 'test' AND id IN (SELECT id FROM full_registry)) AS reviewed_in_test,
  count(*) FILTER (split = 'test' AND id IN (SELECT id FROM frozen)) AS frozen_in_test,
  count(*) FILTER (split = 'train' AND id IN (SELECT id FROM frozen)) AS frozen_in_train FROM split3""",
    "split3", "full_registry", "frozen",
))
def c14_leaks(spark, folder):
    frozen = splits.freeze_hard_cases(V.clean_reaudit(spark, folder))
    return splits.leak_counts(splits.stratified_split(V.dataset(spark, folder)), V.full_registry(spark, folder), frozen)


@query(
    "c15_review_sample",
    with_views(
        """SELECT id, category, label FROM split4 WHERE split = 'train' AND id NOT IN (SELECT id FROM full_registry)
ORDER BY md5('42:' || CAST(id AS VARCHAR)), id LIMIT 250""",
        "split4", "full_registry",
    ),
)
def c15(spark, folder):
    train = _split4(spark, folder).filter("split = 'train'").select("id", "category", "label")
    return splits.review_sample(train, V.full_registry(spark, folder))


@query(
    "c16_sized_sample",
    with_views(
        """SELECT id, category, label FROM
(SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || CAST(id AS VARCHAR))) AS place FROM dataset) WHERE place <= 500""",
        "dataset",
    ),
)
def c16(spark, folder):
    return splits.sized_sample(V.dataset(spark, folder), 500, strata=["category"])


@query(
    "c16_fraction_samples",
    with_views(
        """SELECT id, category, label, fraction FROM (SELECT *, unnest([0.25E0, 0.5E0, 0.75E0, 1.0E0]) AS fraction FROM
(SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || CAST(id AS VARCHAR))) AS place,
   count(*) OVER (PARTITION BY category) AS n FROM dataset)) WHERE place <= floor(n * fraction)""",
        "dataset",
    ),
)
def c16_fractions(spark, folder):
    return splits.fraction_samples(V.dataset(spark, folder))


@query(
    "c18_holdout",
    with_views(
        """SELECT id, label, CASE WHEN place <= floor(n * 8 / 100.0) THEN 'val' ELSE 'fit' END AS part FROM
(SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR))) AS place, count(*) OVER () AS n FROM dataset)""",
        "dataset",
    ),
)
def c18(spark, folder):
    return splits.holdout(V.dataset(spark, folder).select("id", "label"))


WEIGHTS = """SELECT label, count(*) AS rows, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS class_weight FROM dataset GROUP BY label"""


@query("a17_class_weights", with_views(f"SELECT label, rows, round(class_weight, 6) AS class_weight FROM ({WEIGHTS})", "dataset"))
def a17(spark, folder):
    return splits.class_weights(V.dataset(spark, folder)).withColumn("class_weight", F.round("class_weight", 6))


@query(
    "c17_row_weights",
    with_views(
        f"""SELECT d.id, round(w.class_weight * CASE WHEN d.id IN (SELECT id FROM full_registry
  WHERE audit_status = 'true_model_wrong_negative' OR contains(notes, 'mixed_but_neutral')) THEN 4 ELSE 1 END, 6) AS weight
FROM dataset d JOIN ({WEIGHTS}) w ON w.label = d.label""",
        "dataset", "full_registry",
    ),
)
def c17(spark, folder):
    rows = splits.row_weights(V.dataset(spark, folder), V.full_registry(spark, folder), 4.0)
    return rows.select("id", F.round("weight", 6).alias("weight"))


@query(
    "u7_training_pools",
    with_views(
        """SELECT id, label, 'verified' AS pool FROM dataset WHERE id IN (SELECT id FROM full_registry)
UNION ALL SELECT id, label, 'raw' FROM (SELECT * FROM dataset WHERE id NOT IN (SELECT id FROM full_registry)
  ORDER BY md5('42:' || CAST(id AS VARCHAR)) LIMIT 1000)""",
        "dataset", "full_registry",
    ),
)
def u7(spark, folder):
    verified, raw = splits.verified_and_raw(V.dataset(spark, folder).select("id", "label"), V.full_registry(spark, folder))
    return curation.pool(("verified", verified), ("raw", splits.sized_sample(raw, 1000)))


@query(
    "w1_numbered_feed",
    with_views("SELECT review_id, review_date, row_number() OVER (ORDER BY review_date DESC, review_id) AS position FROM reviews", "reviews"),
)
def w1_numbered(spark, folder):
    rows = V.reviews(spark, folder).select("review_id", "review_date")
    return ranking.with_position(rows, F.desc("review_date"), F.asc("review_id"))


