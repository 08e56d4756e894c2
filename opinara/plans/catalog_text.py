"""Queries for cleaning and sentences over whole documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from opinara.functions import cleaning, sentences
from opinara.operators import clustering, curation
from opinara.plans import driver_views as V
from opinara.plans.catalog import query
from opinara.plans.oracle_views import with_views

# The SQL engine's patterns are ASCII by default, so space is spelled out.
PIECES = r"""list_filter(list_transform(string_split(regexp_replace(trim(text, chr(32) || chr(10) || chr(9) || chr(13)),
  '([.!?])[\s]+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, chr(32) || chr(10) || chr(9) || chr(13))), lambda s: s <> '')"""


def _gone(text: str, *patterns: str) -> str:
    for pattern in patterns:
        text = f"regexp_replace({text}, '{pattern}', ' ', 'g')"
    return text


# The documents hold no entities and are in NFKC already, so SQL can follow the rest of the cleaning.
# The patterns of what the cleaners remove, the same as in the functions they check.
MEDIA = r"(?i)\b(?:video|image){0}id[a-zA-Z0-9_-]+\b"
HEX = r"\b[a-fA-F0-9]{20,}\b"
UUIDS = r"\b[a-fA-F0-9]{8}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-[a-fA-F0-9]{12}\b"
LIGHT = _gone("text", r"(?i)https?://\S+|www\.\S+", "<[^>]+>", MEDIA.format(""), HEX, UUIDS, r"[\x00-\x1f\x7f-\x{9f}]", r"\s+")
INFERENCE = f"""SELECT doc_id, upper(substr(t, 1, 1)) || substr(t, 2) AS clean FROM (SELECT doc_id, array_to_string(list_transform(
  string_split(t, '. '), lambda s, i: CASE WHEN i > 1 AND regexp_matches(s, '^[a-z]') THEN upper(substr(s, 1, 1)) || substr(s, 2) ELSE s END), '. ') AS t
FROM (SELECT doc_id, nullif(trim({LIGHT}), '') AS t FROM documents))"""


def _heavy(*more: str) -> str:
    bare = _gone("text", r"https?://\S+|www\.\S+", "<[^>]+>", MEDIA.format("[_-]?"), HEX, r"[\x00-\x1f\x7f-\x{9f}\x{200b}\x{200e}\x{200f}\x{feff}]", *more)
    for letter in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
        bare = f"regexp_replace({bare}, '{letter}{{3,}}', '{letter}{letter}', 'g')"
    return bare


def _cut(text: str, marks: str, kept: int) -> str:
    for mark in marks:
        text = f"regexp_replace({text}, '[{mark}]{{2,}}', '{mark * kept}', 'g')"
    return text


def _trained(bare: str) -> str:
    return f"""SELECT doc_id, CASE WHEN length(t) >= 2 THEN t END AS clean
FROM (SELECT doc_id, lower(trim(regexp_replace({bare}, '\\s+', ' ', 'g'))) AS t FROM documents)"""


TRAINING = _trained(_cut(_cut(_heavy(), "!?", 2), ",.-;:", 1))
STRICT = _trained(_cut(_heavy(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E0}-\x{1F1FF}]+"), "!?,.-;:", 1))


@query("x1_clean_for_inference", INFERENCE)
def x1(spark, folder):
    docs = V.texts(spark, folder)
    return docs.select("doc_id", cleaning.clean_for_inference(F.col("text")).alias("clean"))


@query("x1_clean_pages")
def x1_pages(spark, folder):
    pages = V.table(spark, folder, "pages")
    return pages.select("page_id", cleaning.clean_for_inference(F.col("html")).alias("clean"))


@query(
    "x2_clean_or_raw",
    f"""SELECT doc_id AS id, coalesce(clean, text) AS shown FROM documents JOIN ({INFERENCE}) USING (doc_id)
UNION ALL SELECT -1 - page_id, url FROM pages""",
)
def x2(spark, folder):
    """Cleaned texts, and urls, of which cleaning leaves nothing, as they are."""
    rows = V.texts(spark, folder).select(F.col("doc_id").alias("id"), "text")
    rows = rows.unionByName(V.table(spark, folder, "pages").select((-1 - F.col("page_id")).alias("id"), F.col("url").alias("text")))
    return rows.select("id", cleaning.clean_or_raw(F.col("text")).alias("shown"))


@query("x3_clean_for_training", TRAINING)
def x3(spark, folder):
    docs = V.texts(spark, folder)
    return docs.select("doc_id", cleaning.clean_for_training(F.col("text")).alias("clean"))


@query("x4_clean_strict", STRICT)
def x4(spark, folder):
    docs = V.texts(spark, folder)
    return docs.select("doc_id", cleaning.clean_strict(F.col("text")).alias("clean"))


@query(
    "x8_sentences",
    f"SELECT doc_id, CAST(len(p) AS INTEGER) AS sentences, md5(array_to_string(p, '|')) AS digest FROM (SELECT doc_id, {PIECES} AS p FROM documents)",
)
def x8(spark, folder):
    pieces = sentences.sentences(F.col("text"))
    return V.texts(spark, folder).select(
        "doc_id", F.size(pieces).alias("sentences"), F.md5(F.array_join(pieces, "|")).alias("digest")
    )


@query(
    "x9_last_sentences",
    f"""SELECT doc_id, CASE WHEN len(p) >= 6 THEN array_to_string(p[-3:], ' ') ELSE text END AS kept
FROM (SELECT doc_id, text, {PIECES} AS p FROM documents)""",
)
def x9(spark, folder):
    return V.texts(spark, folder).select("doc_id", sentences.last_sentences(F.col("text")).alias("kept"))


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


OPINION = f"""WITH pieces AS (SELECT doc_id, text, {PIECES} AS p FROM documents),
flat AS (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS i FROM pieces),
worded AS (SELECT *, regexp_extract_all(lower(s), '[a-z'']+') AS w FROM flat),
scored AS (SELECT doc_id, s, i, CASE WHEN len(w) = 0 THEN 0.0E0 ELSE
  (2.0E0 * len(list_filter(w, lambda x: list_contains({_quoted(sentences.OPINION_WORDS)}, x)))
   + len(list_filter(w, lambda x: list_contains({_quoted(sentences.FIRST_PERSON)}, x)))
   + 1.5E0 * (length(s) - length(replace(s, '!', ''))) - CASE WHEN len(w) > 30 THEN 1.0E0 ELSE 0.0E0 END) / len(w) END AS score
  FROM worded),
best AS (SELECT doc_id, list(s) AS chosen FROM
  (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS place FROM scored) WHERE place <= 3 GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN len(d.p) >= 6 THEN array_to_string(list_filter(d.p, lambda s: list_contains(b.chosen, s)), ' ')
  ELSE d.text END AS kept FROM pieces d LEFT JOIN best b ON b.doc_id = d.doc_id"""


@query("x10_top_opinions", OPINION)
def x10(spark, folder):
    return V.texts(spark, folder).select("doc_id", sentences.top_opinions(F.col("text")).alias("kept"))


@query(
    "w12_sentence_window",
    f"SELECT doc_id, array_to_string(p[-2:], ' ') AS tail, p[1] AS first FROM (SELECT doc_id, {PIECES} AS p FROM documents) WHERE len(p) >= 2",
)
def w12(spark, folder):
    pieces = sentences.sentences(F.col("text"))
    cut = V.texts(spark, folder).select("doc_id", pieces.alias("p")).filter(F.size("p") >= 2)
    return cut.select("doc_id", F.array_join(F.slice("p", -2, 2), " ").alias("tail"), F.col("p")[0].alias("first"))


@query(
    "a18_duplicate_texts",
    """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, round(sum(n - 1) / sum(n), 6) AS rate,
  sum(n - 1) / sum(n) > 0.02 AS too_many FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)""",
)
def a18(spark, folder):
    return curation.duplicate_texts(V.documents(spark, folder))


TERM_STOP_WORDS = ("the", "and", "of", "in", "to", "un", "la", "le", "der", "die", "und", "el", "de")

TERMS = f"""docs AS (SELECT id, cluster_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
  lambda x: NOT list_contains({_quoted(TERM_STOP_WORDS)}, x)) AS w FROM clusters),
terms AS (SELECT id, cluster_id, unnest(w) AS term FROM docs
  UNION ALL SELECT id, cluster_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM docs),
counted AS (SELECT id, cluster_id, term, count(*) AS tf FROM terms GROUP BY ALL),
vocab AS (SELECT term, sum(tf) AS uses, count(*) AS df FROM counted GROUP BY term ORDER BY uses DESC, term LIMIT 2000),
weighted AS (SELECT c.id, c.cluster_id, c.term, tf * (ln((1.0E0 + (SELECT count(*) FROM docs)) / (1.0E0 + df)) + 1.0E0) AS w
  FROM counted c JOIN vocab v ON v.term = c.term),
norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY id),
sizes AS (SELECT cluster_id, count(*) AS size FROM docs GROUP BY cluster_id),
means AS (SELECT w.cluster_id, s.size, w.term, round(sum(w.w / n.norm) / s.size, 9) AS weight
  FROM weighted w JOIN norms n ON n.id = w.id JOIN sizes s ON s.cluster_id = w.cluster_id WHERE s.size >= 5 GROUP BY w.cluster_id, s.size, w.term),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY weight DESC, term) AS rank FROM means)"""


def _with_terms(body: str) -> str:
    head, _ = with_views("SELECT 1", "clusters").rsplit("\n", 1)
    return f"{head},\n{TERMS}\n{body}"


def _terms(spark, folder):
    return clustering.cluster_terms(V.clusters(spark, folder), stop_words=TERM_STOP_WORDS)


@query("w9_cluster_terms", _with_terms("SELECT cluster_id, size, CAST(rank AS INTEGER) AS rank, term, round(weight, 6) AS weight FROM ranked WHERE rank <= 10"))
def w9(spark, folder):
    return _terms(spark, folder).withColumn("weight", F.round("weight", 6))


@query(
    "m7_naming_worksheet",
    _with_terms(
        """SELECT cluster_id, size, string_agg(term, ', ' ORDER BY rank) AS top_terms, '' AS suggested_name
FROM ranked WHERE rank <= 10 GROUP BY cluster_id, size"""
    ),
)
def m7(spark, folder):
    return clustering.naming_worksheet(_terms(spark, folder))


@query(
    "w10_cluster_samples",
    with_views(
        """SELECT cluster_id, CAST(sample AS INTEGER) AS sample, id, substr(coalesce(text, ''), 1, 150) AS text FROM
(SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY id) AS sample FROM clusters) WHERE sample <= 3""",
        "clusters",
    ),
)
def w10(spark, folder):
    return clustering.cluster_samples(V.clusters(spark, folder))


NAMES = {0: "late_parcels", 1: "torn_seams", 2: "misc", 3: "refund_trouble", 4: "noisy_motor"}


@query(
    "j9_cluster_names",
    with_views(
        """SELECT id, cluster_id, CASE cluster_id WHEN 0 THEN 'late_parcels' WHEN 1 THEN 'torn_seams' WHEN 2 THEN 'misc'
  WHEN 3 THEN 'refund_trouble' WHEN 4 THEN 'noisy_motor' END AS suggested_name FROM clusters""",
        "clusters",
    ),
)
def j9(spark, folder):
    return clustering.apply_names(V.clusters(spark, folder).select("id", "cluster_id"), NAMES)
