"""The views of ``driver_views`` as SQL, for checking query results in another engine."""

from __future__ import annotations

LABEL_OF_ID = "CASE {0} WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' END"

SENTIMENT_SUMS = """CAST(count(*) FILTER (sentiment = 'positive') AS BIGINT) AS positive,
  CAST(count(*) FILTER (sentiment = 'neutral') AS BIGINT) AS neutral,
  CAST(count(*) FILTER (sentiment = 'negative') AS BIGINT) AS negative,
  CAST(count(*) FILTER (sentiment IS NULL OR sentiment NOT IN ('positive', 'neutral', 'negative')) AS BIGINT) AS unlabelled"""

CELLS = ",\n  ".join(f"count(*) FILTER (y = {a} AND pred = {p}) AS n{a}{p}" for a in range(3) for p in range(3))



def _layer(source: str, rows: int, columns: int, layer: int) -> str:
    """One dense layer with the formula weights of ``scoring.fixed_weights``."""
    weight = f"(((i + 1) * {7 + 2 * layer} + (j + 1) * 13) % 17 - 8) / 17.0E0"
    terms = f"list_sum(list_transform(range(0, {rows}), lambda i: {source}[i + 1] * {weight}))"
    return f"list_transform(range(0, {columns}), lambda j: (j % 5 - 2) / 10.0E0 + {terms})"


def _relu(values: str) -> str:
    return f"list_transform({values}, lambda x: greatest(x, 0.0E0))"


# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "ev": ((), "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"),
    "reviews0": (
        ("ev",),
        """SELECT event_id AS review_id, 'b' || CAST(user_id % 4 AS VARCHAR) AS batch_id,
  'u' || CAST(user_id AS VARCHAR) AS session_id, event_type AS category,
  CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 101 = 0 THEN '2024-13-45'
       ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS review_date,
  k, k / 100.0E0 AS confidence_margin,
  CASE WHEN value >= 69 THEN 'negative' WHEN value >= 34 THEN 'neutral' ELSE 'positive' END AS sentiment, ts
FROM ev""",
    ),
    "reviews": (
        ("reviews0",),
        """SELECT *,
  CASE WHEN sentiment = 'negative' THEN 'issue_' || CAST(k % 8 AS VARCHAR) END AS issue_tag,
  CASE WHEN sentiment = 'negative' THEN CASE WHEN k % 2 = 0 THEN 'per_category' ELSE 'cross_category_fallback' END END
    AS cluster_source,
  coalesce(strftime(TRY_CAST(nullif(review_date, '') AS DATE), '%G-W%V'), 'unknown') AS week
FROM reviews0""",
    ),
    "trend": (("reviews",), f"SELECT batch_id, category, week, {SENTIMENT_SUMS} FROM reviews GROUP BY ALL"),
    "cats": (("reviews",), f"SELECT batch_id, category, {SENTIMENT_SUMS} FROM reviews GROUP BY ALL"),
    "issues": (
        ("reviews",),
        """SELECT batch_id, issue_tag, cluster_source, week, count(*) AS count FROM reviews
WHERE issue_tag IS NOT NULL GROUP BY ALL""",
    ),
    "issues_by_category": (
        ("reviews",),
        """SELECT batch_id, issue_tag, cluster_source, week, category, count(*) AS count FROM reviews
WHERE issue_tag IS NOT NULL GROUP BY ALL""",
    ),
    "parts": (
        ("reviews",),
        """SELECT review_id AS id, category,
  CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS y,
  CAST(review_id * 37 % 101 + 1 AS DOUBLE) AS a, CAST(review_id * 53 % 97 + 1 AS DOUBLE) AS b,
  CAST(review_id * 71 % 89 + 1 AS DOUBLE) AS c
FROM reviews""",
    ),
    "probs": (
        ("parts",),
        """SELECT id, category, y, CASE WHEN y = 1 AND id % 5 = 0 THEN 'frozen' ELSE 'test' END AS eval_set,
  a / (a + b + c) AS prob_negative, b / (a + b + c) AS prob_neutral, c / (a + b + c) AS prob_positive
FROM parts""",
    ),
    "predictions": (
        ("probs",),
        """SELECT *,
  CASE WHEN prob_negative >= prob_neutral AND prob_negative >= prob_positive THEN 0
       WHEN prob_neutral >= prob_positive THEN 1 ELSE 2 END AS pred,
  list_reverse_sort([prob_negative, prob_neutral, prob_positive])[1]
    - list_reverse_sort([prob_negative, prob_neutral, prob_positive])[2] AS lead
FROM probs""",
    ),
    "cells": (("predictions",), f"SELECT eval_set, {CELLS} FROM predictions GROUP BY eval_set"),
    "all_cells": (("predictions",), f"SELECT {CELLS} FROM predictions"),
    "votes": (
        ("reviews",),
        """SELECT CASE WHEN review_id % 40 = 0 THEN review_id ELSE review_id // 5 END AS review_id,
  CASE WHEN review_id % 17 <> 0 THEN session_id || '_' || CAST(k % 5 AS VARCHAR) END AS session_id,
  sentiment AS manual_label, review_date AS date, confidence_margin, review_id AS vote_id
FROM reviews""",
    ),
    "dominance": (
        ("votes",),
        """SELECT session_id, CAST(sum(n) AS BIGINT) AS votes, max(n) / sum(n) AS dominant_ratio FROM
(SELECT session_id, manual_label, CAST(count(*) AS DOUBLE) AS n FROM votes WHERE session_id IS NOT NULL GROUP BY ALL)
GROUP BY session_id""",
    ),
    "flagged": (("dominance",), "SELECT session_id FROM dominance WHERE votes >= 3 AND dominant_ratio > 0.7"),
    "kept_votes": (
        ("votes", "flagged"),
        "SELECT * FROM votes WHERE session_id IS NULL OR session_id NOT IN (SELECT session_id FROM flagged)",
    ),
    "tallies": (
        ("kept_votes",),
        """SELECT review_id, manual_label, count(*) AS n,
  row_number() OVER (PARTITION BY review_id ORDER BY count(*) DESC, manual_label DESC) AS place
FROM kept_votes GROUP BY review_id, manual_label""",
    ),
    "ballots": (
        ("votes", "kept_votes", "tallies"),
        """SELECT v.review_id, coalesce(k.votes, 0) AS votes, coalesce(k.sessions, 0) AS sessions, k.confidence_margin,
  t1.manual_label AS majority, t1.n IS NOT NULL AND t1.n = coalesce(t2.n, 0) AS tie
FROM (SELECT DISTINCT review_id FROM votes) v
LEFT JOIN (SELECT review_id, count(*) AS votes, count(DISTINCT session_id) AS sessions,
             arg_min(confidence_margin, struct_pack(d := date, v := vote_id)) AS confidence_margin
           FROM kept_votes GROUP BY review_id) k ON k.review_id = v.review_id
LEFT JOIN tallies t1 ON t1.review_id = v.review_id AND t1.place = 1
LEFT JOIN tallies t2 ON t2.review_id = v.review_id AND t2.place = 2""",
    ),
    "routed": (
        ("ballots", "reviews"),
        """SELECT b.*, CASE WHEN votes = 0 THEN 'excluded_session' WHEN sessions < 2 THEN 'deferred_volume'
  WHEN tie THEN 'excluded_tie' WHEN r.review_id IS NOT NULL AND b.confidence_margin > 0.7 THEN 'applied_flagged'
  WHEN r.review_id IS NOT NULL THEN 'applied' ELSE 'new_text' END AS status
FROM ballots b LEFT JOIN (SELECT review_id FROM reviews WHERE category NOT IN ('purchase', 'view')) r ON r.review_id = b.review_id""",
    ),
    "corrections": (
        ("votes",),
        """SELECT CAST(vote_id AS VARCHAR) AS correction_id, review_id,
  CASE WHEN vote_id % 19 <> 0 THEN 'b' || CAST(vote_id % 4 AS VARCHAR) END AS batch_id,
  'said "' || CAST(vote_id AS VARCHAR) || '", then' || chr(10) || 'left' AS text,
  CASE vote_id % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS label,
  manual_label, date, coalesce(session_id, '') AS session_id, confidence_margin
FROM votes""",
    ),
    "dataset": (("reviews",), "SELECT review_id AS id, category, sentiment AS label FROM reviews"),
    "audit": (
        ("reviews",),
        """SELECT review_id AS id, sentiment AS actual_label,
  CASE WHEN k = 98 THEN 'no_such_bucket' WHEN k = 99 THEN NULL WHEN k % 3 = 0 THEN 'mislabel'
       WHEN k % 3 = 1 THEN 'genuinely_mixed' ELSE 'model_wrong' END AS manual_label,
  CASE WHEN k = 95 THEN 'meh' WHEN k = 94 THEN 'negative' WHEN k % 3 <> 0 THEN 'neutral'
       WHEN k % 2 = 0 THEN 'negative' ELSE 'positive' END AS corrected_label
FROM reviews WHERE sentiment = 'neutral'""",
    ),
    "audit_violations": (
        ("audit",),
        """SELECT id, 'not_reviewed' AS rule FROM audit WHERE manual_label IS NULL
UNION ALL SELECT id, 'unknown_bucket' FROM audit WHERE manual_label NOT IN ('mislabel', 'genuinely_mixed', 'model_wrong')
UNION ALL SELECT id, 'unknown_label' FROM audit
  WHERE corrected_label IS NULL OR corrected_label NOT IN ('negative', 'neutral', 'positive')
UNION ALL SELECT id, 'bucket_contradicts_label' FROM audit
  WHERE manual_label IN ('genuinely_mixed', 'model_wrong') AND corrected_label IS DISTINCT FROM 'neutral'""",
    ),
    "clean_audit": (
        ("audit", "audit_violations"),
        "SELECT * FROM audit WHERE id NOT IN (SELECT id FROM audit_violations)",
    ),
    "reaudit": (
        ("reviews",),
        """SELECT review_id AS id, sentiment AS actual_label,
  CASE WHEN k = 97 THEN '' WHEN k = 96 THEN 'no_such_bucket' WHEN k % 5 = 0 THEN 'mislabel_negative'
       WHEN k % 5 = 1 THEN 'mislabel_positive' WHEN k % 5 = 2 THEN 'genuinely_mixed'
       WHEN k % 5 = 3 THEN 'true_model_wrong_negative' ELSE 'true_model_wrong_positive' END AS primary_bucket,
  CASE WHEN k = 93 THEN 'no_such_subtype' WHEN k = 88 THEN NULL WHEN k % 4 = 0 THEN 'mixed_but_neutral'
       WHEN k % 4 = 1 THEN 'weak_sentiment' WHEN k % 4 = 2 THEN 'ambiguous' ELSE 'hedged_sentiment' END AS error_subtype,
  CASE WHEN k % 6 <> 0 THEN 'note ' || CAST(k AS VARCHAR) END AS notes
FROM reviews WHERE sentiment = 'neutral'""",
    ),
    "reaudit_violations": (
        ("reaudit",),
        """SELECT id, 'not_reviewed' AS rule FROM reaudit WHERE coalesce(primary_bucket, '') = ''
UNION ALL SELECT id, 'unknown_bucket' FROM reaudit WHERE primary_bucket <> '' AND primary_bucket NOT IN
  ('mislabel_negative', 'mislabel_positive', 'genuinely_mixed', 'true_model_wrong_negative', 'true_model_wrong_positive')
UNION ALL SELECT id, 'missing_subtype' FROM reaudit
  WHERE primary_bucket LIKE 'true_model_wrong%' AND coalesce(error_subtype, '') = ''
UNION ALL SELECT id, 'unknown_subtype' FROM reaudit
  WHERE primary_bucket LIKE 'true_model_wrong%' AND error_subtype <> '' AND error_subtype NOT IN
  ('factual_neutral', 'weak_sentiment', 'hedged_sentiment', 'mixed_but_neutral', 'ambiguous', 'sarcasm_or_context')""",
    ),
    "clean_reaudit": (
        ("reaudit", "reaudit_violations"),
        "SELECT * FROM reaudit WHERE id NOT IN (SELECT id FROM reaudit_violations)",
    ),
    "registry": (
        ("clean_audit", "reviews"),
        """SELECT a.id, 'confidence_audit' AS round, 'confidently_wrong_neutral' AS sampling_strategy,
  a.actual_label AS old_label, a.corrected_label AS manual_label, a.manual_label AS audit_status, '' AS notes
FROM clean_audit a JOIN reviews r ON r.review_id = a.id WHERE r.category IN ('click', 'view')""",
    ),
    "full_registry": (
        ("registry", "clean_reaudit"),
        """SELECT * FROM registry UNION ALL
SELECT id, 'model_wrong_reaudit', 'model_wrong_confidence_audit', actual_label, primary_bucket, primary_bucket,
  coalesce(error_subtype, '') || ' | ' || coalesce(notes, '')
FROM clean_reaudit WHERE id NOT IN (SELECT id FROM registry)""",
    ),
    "frozen": (
        ("clean_reaudit",),
        """SELECT * FROM clean_reaudit
WHERE primary_bucket IN ('genuinely_mixed', 'true_model_wrong_negative', 'true_model_wrong_positive')
ORDER BY md5('77:' || CAST(id AS VARCHAR)), id LIMIT 300""",
    ),
    "split3": (
        ("dataset",),
        """SELECT id, category, label, CASE WHEN place <= ceil(n * 15 / 100.0) THEN 'test'
  WHEN place <= 2 * ceil(n * 15 / 100.0) THEN 'val' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(id AS VARCHAR))) AS place,
        count(*) OVER (PARTITION BY label) AS n FROM dataset)""",
    ),
    "split4": (
        ("dataset", "full_registry", "frozen"),
        """SELECT id, category, label, CASE WHEN is_frozen THEN 'frozen' WHEN is_reviewed THEN 'train'
  WHEN place <= ceil(n * 20 / 100.0) THEN 'test' ELSE 'train' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY label, is_frozen OR is_reviewed ORDER BY md5('123:' || CAST(id AS VARCHAR))) AS place,
        count(*) OVER (PARTITION BY label, is_frozen OR is_reviewed) AS n
      FROM (SELECT *, id IN (SELECT id FROM frozen) AS is_frozen, id IN (SELECT id FROM full_registry) AS is_reviewed
            FROM dataset))""",
    ),
    "batches": (
        ("ev",),
        """SELECT 'u' || CAST(user_id AS VARCHAR) AS batch_id, 'u' || CAST(user_id AS VARCHAR) || '.csv' AS filename,
  count(*) AS total_reviews, count(*) FILTER (k >= 10) AS processed_count,
  CASE user_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'done' END AS status,
  CASE WHEN user_id % 7 <> 0 THEN CAST(sum(k) AS VARCHAR) END AS processing_duration_seconds
FROM ev GROUP BY user_id""",
    ),
    "packed": (
        ("trend", "cats", "issues"),
        """SELECT batch_id, 'TREND#' || category || '#' || week AS agg_type, positive, neutral, negative, CAST(NULL AS BIGINT) AS count
FROM trend UNION ALL SELECT batch_id, 'CAT#' || category, positive, neutral, negative, NULL FROM cats
UNION ALL SELECT batch_id, CASE WHEN cluster_source = 'cross_category_fallback' THEN 'ISSUE#' || issue_tag || '#' || week
  ELSE 'ISSUE#' || issue_tag || '#' || cluster_source || '#' || week END, NULL, NULL, NULL, count FROM issues""",
    ),
    "vectors": (
        (),
        """SELECT vec_id AS id, 'c' || CAST(vec_id % 4 AS VARCHAR) AS category,
  CASE label % 3 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' ELSE 'positive' END AS label,
  label AS cluster_id, CAST(embedding AS DOUBLE[]) AS features FROM embeddings""",
    ),
    "train_vectors": (
        ("vectors",),
        """SELECT id, category, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(id AS VARCHAR))) AS place,
  count(*) OVER (PARTITION BY label) AS n FROM vectors) WHERE place > ceil(n * 20 / 100.0)""",
    ),
    "components": (
        ("vectors",),
        """SELECT id, category, cluster_id, unnest(features) AS x, unnest(range(1, len(features) + 1)) AS i FROM vectors""",
    ),
    "means": (
        ("components",),
        """SELECT scope, cluster_id, list(x ORDER BY i) AS centroid FROM
(SELECT 'cross_category_fallback' AS scope, cluster_id, i, avg(x) AS x FROM components GROUP BY cluster_id, i
 UNION ALL SELECT category, cluster_id, i, avg(x) FROM components WHERE category IN ('c0', 'c1') GROUP BY category, cluster_id, i)
GROUP BY scope, cluster_id""",
    ),
    "nearest": (
        ("vectors", "means"),
        """SELECT id, category, label, cluster_source, cluster_id, distance FROM
(SELECT v.id, v.category, v.label, m.cluster_id, list_distance(v.features, m.centroid) AS distance,
   CASE WHEN v.category IN ('c0', 'c1') THEN 'per_category' ELSE 'cross_category_fallback' END AS cluster_source,
   row_number() OVER (PARTITION BY v.id ORDER BY list_distance(v.features, m.centroid), m.cluster_id) AS place
 FROM vectors v JOIN means m
   ON m.scope = CASE WHEN v.category IN ('c0', 'c1') THEN v.category ELSE 'cross_category_fallback' END)
WHERE place = 1""",
    ),
    "forward": (
        ("vectors",),
        f"""SELECT id, category, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM
(SELECT id, category, {_layer("h2", 128, 3, 2)} AS logits FROM
  (SELECT id, category, {_relu(_layer("h1", 256, 128, 1))} AS h2 FROM
    (SELECT id, category, {_relu(_layer("features", 64, 256, 0))} AS h1 FROM vectors)))""",
    ),
    "class_probs": (
        ("forward",),
        """SELECT id, category, e[1] / list_sum(e) AS prob_negative, e[2] / list_sum(e) AS prob_neutral,
  e[3] / list_sum(e) AS prob_positive FROM forward""",
    ),
    "scored": (
        ("class_probs",),
        """SELECT *, CASE WHEN (top = 2 AND lead < 0.3) OR (top = 0 AND lead < 0.0) THEN 1 ELSE top END AS decided FROM
(SELECT *, CASE WHEN prob_negative >= prob_neutral AND prob_negative >= prob_positive THEN 0
   WHEN prob_neutral >= prob_positive THEN 1 ELSE 2 END AS top,
   list_reverse_sort([prob_negative, prob_neutral, prob_positive])[1]
     - list_reverse_sort([prob_negative, prob_neutral, prob_positive])[2] AS lead FROM class_probs)""",
    ),
    "clusters": (
        ("vectors",),
        "SELECT v.*, d.text FROM vectors v JOIN documents d ON d.doc_id = v.id",
    ),
}


def with_views(body: str, *names: str) -> str:
    """``body`` behind a WITH clause holding the named views and everything they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    clauses = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered)
    return f"WITH {clauses}\n{body}" if clauses else body


# Metric formulas over the nine cells.


def actual(c: int) -> str:
    return f"(n{c}0 + n{c}1 + n{c}2)"


def predicted(c: int) -> str:
    return f"(n0{c} + n1{c} + n2{c})"


def ratio(top: str, bottom: str) -> str:
    return f"(CASE WHEN {bottom} > 0 THEN CAST({top} AS DOUBLE) / {bottom} ELSE 0.0E0 END)"


def recall(c: int) -> str:
    return ratio(f"n{c}{c}", actual(c))


def precision(c: int) -> str:
    return ratio(f"n{c}{c}", predicted(c))


def f1(c: int) -> str:
    return ratio(f"2.0E0 * n{c}{c}", f"({actual(c)} + {predicted(c)})")


def macro_f1() -> str:
    occurs = " + ".join(f"(CASE WHEN {actual(c)} + {predicted(c)} > 0 THEN 1 ELSE 0 END)" for c in range(3))
    return ratio(f"({f1(0)} + {f1(1)} + {f1(2)})", f"({occurs})")


def accuracy() -> str:
    return ratio("(n00 + n11 + n22)", f"({actual(0)} + {actual(1)} + {actual(2)})")


OVERALL = (
    f"round({accuracy()}, 6) AS accuracy, round({macro_f1()}, 6) AS macro_f1, round({f1(1)}, 6) AS neutral_f1, "
    f"round({recall(0)}, 6) AS negative_recall, round({recall(1)}, 6) AS neutral_recall"
)
