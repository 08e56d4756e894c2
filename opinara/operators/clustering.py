"""Issue clusters: fitting, naming, tagging, comparing.

Input rows carry id, category, features (array<float>) and, for naming, text.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinara.functions.binding import let
from opinara.functions.vectors import MODEL_BYTES_LIMIT, CentroidSet, distance_between, issue_tagger
from opinara.operators import kmeans
from opinara.operators.ranking import exact_percentiles, lookup, small_side
from opinara.schema import CENTROIDS, CLUSTER_VOLUME_GATE, FALLBACK_SCOPE, OTHER_ISSUE, PER_CATEGORY
from opinara.session import cut

GLOBAL_CLUSTERS = 15
CATEGORY_CLUSTERS = 10
VOCABULARY = 2000
MIN_CLUSTER = 5
PIECE_BYTES = 16 << 20  # of text in a task, whose terms take some twenty times that
SEPARATOR = "\u0001"


def fit_global(rows: DataFrame, k: int = GLOBAL_CLUSTERS, seeds: Sequence[int] = (42,), max_iter: int = kmeans.MAX_ITER) -> kmeans.Fit:
    """k-means over all rows; of several seeds, which are fitted in the same passes, that of least inertia."""
    found = list(kmeans.best(kmeans.fit(rows, (k,), seeds, max_iter=max_iter)).values())
    if not found:
        raise ValueError("no rows with a vector")
    return found[0]


def inertia_sweep(
    rows: DataFrame, ks: Sequence[int] = (5, 10, 15, 20, 25, 30), seeds: Sequence[int] = (42,), max_iter: int = kmeans.MAX_ITER
) -> DataFrame:
    """Least inertia of all seeds per k: where the curve stops dropping is a starting point for k."""
    found = kmeans.best(kmeans.fit(rows, ks, seeds, max_iter=max_iter))
    table = [(k, one.inertia, len(one.centers), int(one.sizes.sum())) for (_, k), one in sorted(found.items(), key=lambda x: x[0][1])]
    return rows.sparkSession.createDataFrame(table, "k int, inertia double, clusters int, rows long")


def _centroid_rows(scope: str, centers: np.ndarray) -> list[tuple]:
    return [(scope, i, None, None, [float(x) for x in center]) for i, center in enumerate(centers)]


def centroid_frame(spark: SparkSession, model: kmeans.Fit, scope: str = FALLBACK_SCOPE) -> DataFrame:
    return spark.createDataFrame(_centroid_rows(scope, model.centers), CENTROIDS)


def volume_gate(rows: DataFrame, gate: int = CLUSTER_VOLUME_GATE) -> DataFrame:
    """Categories with enough complaints to be clustered on their own."""
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= gate)


def in_eligible(rows: DataFrame, gate: int = CLUSTER_VOLUME_GATE) -> DataFrame:
    eligible = small_side(volume_gate(rows, gate).select("category"))
    return rows.join(eligible, "category", "left_semi")


def _sets(table: DataFrame) -> dict[str, CentroidSet]:
    grouped: dict[str, list] = {}
    for row in table.orderBy("scope", "cluster_id").collect():
        grouped.setdefault(row["scope"], []).append(row)
    return {
        scope: CentroidSet(
            np.array([r["centroid"] for r in rows], dtype=np.float64),
            tuple(r["name"] for r in rows),
            tuple(r["threshold"] for r in rows),
        )
        for scope, rows in grouped.items()
    }


def category_blocks(centroids: DataFrame) -> int:
    """How many blocks of categories keep each block's centroids under half the broadcast limit."""
    size = centroids.agg(F.sum(F.size("centroid")) * 8).first()[0] or 0
    return max(1, -(-2 * size // MODEL_BYTES_LIMIT))


def tag_issues(reviews: DataFrame, centroids: DataFrame, features: str = "features") -> DataFrame:
    """Adds cluster_id, issue_tag, issue_distance and cluster_source to the reviews with a vector.

    A category with its own centroids uses them; every other uses the fallback set. When the
    whole centroid table is too large to broadcast, blocks of categories are tagged in turn.
    """
    spark = reviews.sparkSession
    centroids = cut(centroids)
    blocks = category_blocks(centroids)

    def tag(part: DataFrame, table: DataFrame) -> DataFrame:
        issue = issue_tagger(spark, _sets(table))
        return part.withColumn("_issue", issue(F.col(features), F.col("category"))).select(*reviews.columns, "_issue.*")

    if blocks == 1:
        return tag(reviews, centroids)
    block_of = F.pmod(F.xxhash64(F.coalesce("category", F.lit(""))), F.lit(blocks))
    scope_of = F.pmod(F.xxhash64("scope"), F.lit(blocks))
    tagged = None
    for block in range(blocks):
        table = centroids.filter((scope_of == block) | (F.col("scope") == FALLBACK_SCOPE))
        part = tag(reviews.filter(block_of == block), table)
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged


def fit_per_category(
    rows: DataFrame,
    k: int = CATEGORY_CLUSTERS,
    gate: int = CLUSTER_VOLUME_GATE,
    seeds: Sequence[int] = (42,),
    max_iter: int = kmeans.MAX_ITER,
    tol: float = 1e-4,
) -> DataFrame:
    """k-means inside every eligible category, all categories and seeds in the same passes: a centroid table.

    Rows lie where they were read and are summed where they lie, so a category holding a third of
    all rows is spread like any other.
    """
    spark = rows.sparkSession
    key = ["id"] if "id" in rows.columns else []
    members = in_eligible(rows.select(*key, "category", "features"), gate)
    found = kmeans.best(kmeans.fit(members, (k,), seeds, F.col("category"), *key, max_iter=max_iter, tol=tol))
    return spark.createDataFrame([row for (scope, _), one in found.items() for row in _centroid_rows(scope, one.centers)], CENTROIDS)


def nearest_holds(rows: DataFrame, centroids: DataFrame, scope: Column, cluster: str = "cluster_id", slack: float = 1e-9) -> DataFrame:
    """rows and misplaced per scope: how many lie nearer to another centroid of their scope than to their own."""
    sets = centroids.groupBy("scope").agg(F.map_from_entries(F.collect_list(F.struct("cluster_id", "centroid"))).alias("_set"))
    held = rows.withColumn("_scope", scope).join(small_side(sets).withColumnRenamed("scope", "_scope"), "_scope")
    own = distance_between(F.col("features"), F.element_at("_set", F.col(cluster)))
    nearer = F.exists(F.map_values("_set"), lambda c: distance_between(F.col("features"), c) < F.col("_own") - slack)
    counted = held.withColumn("_own", own).groupBy(F.col("_scope").alias("scope"))
    return counted.agg(F.count(F.lit(1)).alias("rows"), F.count_if(nearer).alias("misplaced"))


def label_centroids(rows: DataFrame, key: str, scope: Column, threshold: float | None = None) -> DataFrame:
    """Mean vector per group as a centroid table; partial sums per component, nothing gathered."""
    mean = Summarizer.mean(array_to_vector(F.col("features").cast("array<double>")))
    means = rows.groupBy(scope.alias("scope"), F.col(key).cast("int").alias("cluster_id")).agg(mean.alias("m"))
    return means.select(
        "scope",
        "cluster_id",
        F.concat(F.lit("issue_"), F.col("cluster_id").cast("string")).alias("name"),
        F.lit(threshold).cast("double").alias("threshold"),
        vector_to_array("m").alias("centroid"),
    )


def own_distance(assigned: DataFrame, centroids: DataFrame, scope: str = FALLBACK_SCOPE) -> DataFrame:
    """Distance of each row to the centroid of its own cluster, for threshold calibration."""
    own = small_side(centroids.filter(F.col("scope") == scope).select("cluster_id", "centroid"))
    return assigned.join(own, "cluster_id").withColumn("distance", distance_between(F.col("features"), F.col("centroid"))).drop("centroid")


def describe(df: DataFrame, value: str, digits: int = 6) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles as (statistic, value) rows."""
    v = F.col(value).cast("double")
    plain = df.agg(
        F.count(v).cast("double").alias("count"), F.avg(v).alias("mean"), F.stddev(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    stats = [F.struct(F.lit(n).alias("statistic"), F.round(F.col(n), digits).alias("value")) for n in plain.columns]
    quartiles = exact_percentiles(df, value, (0.25, 0.5, 0.75)).select(
        F.format_string("%.0f%%", F.col("p") * 100).alias("statistic"), F.round("percentile", digits).alias("value")
    )
    return plain.select(F.inline(F.array(*stats))).unionByName(quartiles)


def calibrate(distances: DataFrame, probs: Sequence[float] = (0.90, 0.95), digits: int = 6) -> DataFrame:
    """Candidate cut-off distances: beyond them a review is none of the known issues."""
    found = exact_percentiles(distances, "distance", probs)
    return found.select("p", F.round("percentile", digits).alias("distance"))


def cluster_quality(tagged: DataFrame, by: Sequence[str] = (), digits: int = 6) -> DataFrame:
    other = F.count_if(F.col("issue_tag") == OTHER_ISSUE)
    return tagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg("issue_distance"), digits).alias("mean_distance"),
        other.alias("other_rows"),
        F.round(other * 100.0 / F.count(F.lit(1)), 4).alias("other_pct"),
    )


def compare_clusterings(rows: DataFrame, centroids: DataFrame, digits: int = 6) -> DataFrame:
    """Global set against per-category sets with fallback: each row is tagged both ways."""
    found = [F.struct("cluster_id", "issue_tag", "issue_distance", "cluster_source").alias(name) for name in "gc"]
    centroids = cut(centroids)
    once = tag_issues(rows.select("category", "features"), centroids.filter(F.col("scope") == FALLBACK_SCOPE)).select("category", "features", found[0])
    both = tag_issues(once, centroids).select("g", found[1])

    def columns(prefix: str, name: str) -> list[Column]:
        other = F.count_if(F.col(f"{prefix}.issue_tag") == OTHER_ISSUE)
        return [
            F.round(F.avg(f"{prefix}.issue_distance"), digits).alias(f"{name}_distance"),
            other.alias(f"{name}_other"),
            F.round(other * 100.0 / F.count(F.lit(1)), 4).alias(f"{name}_other_pct"),
        ]

    reduction = F.round(F.avg(F.col("g.issue_distance") - F.col("c.issue_distance")), digits)
    return both.agg(
        F.count(F.lit(1)).alias("rows"),
        *columns("g", "global"),
        *columns("c", "per_category"),
        F.count_if(F.col("c.cluster_source") == PER_CATEGORY).alias("own_clusters"),
        reduction.alias("distance_reduction"),
    )


def terms(text: Column, stop_words: Sequence[str]) -> Column:
    """Lower-cased words of two or more characters without stop words, then single words and pairs."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))

    def with_pairs(kept: Column) -> Column:
        following = F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.concat(kept, F.zip_with(F.slice(kept, 1, F.size(following)), following, lambda a, b: F.concat(a, F.lit(" "), b)))

    return let(F.filter(words, lambda word: ~word.isin(*stop_words)) if stop_words else words, with_pairs)


def default_stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def _pieces(rows: DataFrame) -> DataFrame:
    """The rows, stored once in pieces of some ``PIECE_BYTES`` of text: a task lists the terms of one piece."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return cut(rows.repartition(-(-size // PIECE_BYTES)) if size > PIECE_BYTES else rows)


def cluster_terms(
    rows: DataFrame,
    top: int = 10,
    vocabulary: int = VOCABULARY,
    min_cluster: int = MIN_CLUSTER,
    stop_words: Sequence[str] | None = None,
    scope: Sequence[str] = (),
) -> DataFrame:
    """The terms with the highest mean TF-IDF per cluster.

    The vocabulary is the most frequent terms of a scope (the corpus, or each category), at most
    ``vocabulary`` per scope. Weights are tf x (ln((1+n)/(1+df))+1), normalised per document; the
    inverse document frequency is computed once, not per cluster. Each row needs ``cluster_id``
    and ``text``.
    """
    scope = list(scope)
    stop_words = default_stop_words() if stop_words is None else stop_words
    joined = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in scope]
    mark = F.concat_ws(SEPARATOR, *joined, F.lit(""))
    found = terms(F.col("text"), stop_words)
    if scope:
        found = let(mark, lambda m: F.transform(found, lambda t: F.concat(m, t)))
    docs = _pieces(rows.select(*scope, "cluster_id", "text")).select(*scope, "cluster_id", found.alias("terms"))

    # Vocabulary and document frequencies: partial counts per term, no row per document is shuffled.
    def tally(found: Column, uses: int, df: int) -> Column:
        return F.transform(found, lambda t: F.struct(t.alias("term"), F.lit(uses).alias("uses"), F.lit(df).alias("df")))

    both = let(F.col("terms"), lambda found: F.concat(tally(found, 1, 0), tally(F.array_distinct(found), 0, 1)))
    seen = docs.select(*scope, F.inline(both))
    counts = seen.groupBy(*scope, "term").agg(F.sum("uses").alias("uses"), F.sum("df").alias("df"))
    order = [F.desc("uses"), F.asc("term")]
    if scope:
        ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*scope).orderBy(*order)))
        frequent = ranked.filter(F.col("_r") <= vocabulary)
    else:
        frequent = counts.orderBy(*order).limit(vocabulary)
    sizes = cut(docs.groupBy(*scope, "cluster_id").agg(F.count(F.lit(1)).alias("size")))
    totals = sizes.groupBy(*scope).agg(F.sum("size").alias("docs"))
    idf = F.log((1.0 + F.col("docs")) / (1.0 + F.col("df"))) + 1.0
    table = small_side(lookup(frequent, totals, scope).select("term", idf.alias("idf")))

    # Only weights that are not zero: one row per document and term of the vocabulary, summed up per cluster and term.
    numbered = docs.withColumn("_doc", F.monotonically_increasing_id())
    listed_terms = numbered.select("_doc", *scope, "cluster_id", F.explode("terms").alias("term")).join(table, "term")
    uses = listed_terms.groupBy("_doc", *scope, "cluster_id", "term", "idf")
    weighted = uses.agg(F.count(F.lit(1)).alias("tf")).withColumn("_w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy("_doc")))
    summed = weighted.withColumn("_unit", F.col("_w") / length).groupBy(*scope, "cluster_id", "term").agg(F.sum("_unit").alias("total"))
    listed = lookup(summed, sizes, [*scope, "cluster_id"]).withColumn("weight", F.round(F.col("total") / F.col("size"), 9)).drop("total", "size")
    named = listed.withColumn("term", F.element_at(F.split("term", SEPARATOR), -1)).filter("weight > 0")
    best = Window.partitionBy(*scope, "cluster_id").orderBy(F.desc("weight"), F.asc("term"))
    kept = lookup(named, sizes.filter(F.col("size") >= min_cluster), [*scope, "cluster_id"])
    return (
        kept.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= top)
        .select(*scope, "cluster_id", "size", "rank", "term", "weight")
    )


def cluster_samples(rows: DataFrame, n: int = 3, chars: int = 150) -> DataFrame:
    """The first texts of each cluster by id. The rank limit is applied before the shuffle."""
    order = Window.partitionBy("cluster_id").orderBy("id")
    picked = rows.withColumn("sample", F.row_number().over(order)).filter(F.col("sample") <= n)
    return picked.select("cluster_id", "sample", "id", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("text"))


def naming_worksheet(term_rows: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """One line per cluster with its size, its top terms and a name for a person to fill in."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda r: r["term"])
    return (
        term_rows.groupBy(*scope, "cluster_id", "size")
        .agg(F.array_join(ordered, ", ").alias("top_terms"))
        .withColumn("suggested_name", F.lit(""))
    )


def apply_names(worksheet: DataFrame, names: dict[int, str]) -> DataFrame:
    """Fill in names by cluster id; unnamed clusters stay null."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return worksheet.withColumn("suggested_name", F.try_element_at(F.create_map(*pairs), F.col("cluster_id")))


def check_names(worksheet: DataFrame) -> None:
    if not worksheet.filter(F.trim(F.coalesce("suggested_name", F.lit(""))) == "").isEmpty():
        raise ValueError("every cluster needs a name before the centroids are exported")


def named_centroids(centroids: DataFrame, worksheet: DataFrame, threshold: float, scope: Sequence[str] = ("scope",)) -> DataFrame:
    """Centroids with names and a cut-off; clusters missing from the worksheet are tagged "other"."""
    check_names(worksheet)
    names = worksheet.select(*scope, "cluster_id", F.col("suggested_name").alias("_name"))
    named = lookup(centroids.drop("name", "threshold"), names, [*scope, "cluster_id"], "left")
    return named.select("scope", "cluster_id", F.col("_name").alias("name"), F.lit(threshold).alias("threshold"), "centroid")
