"""Connected components of a graph given as a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import tables


def _small_star(links: DataFrame) -> DataFrame:
    """Each vertex links its smaller neighbours and itself to the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("n"))
    least = down.groupBy("v").agg(F.min("n").alias("m"))
    joined = down.join(least, "v")
    return joined.select(F.col("n").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Each vertex links its larger neighbours to the smallest of all its neighbours and itself."""
    both = links.select(F.col("a").alias("v"), F.col("b").alias("n")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("n")))
    least = both.groupBy("v").agg(F.least(F.min("n"), F.col("v")).alias("m"))
    joined = both.where("n > v").join(least, "v")
    return joined.select(F.col("n").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """v and root, the smallest vertex of its component, for every vertex that a link (a, b) names.

    Vertices are whole numbers; links to oneself are ignored. A round of both stars halves the longest
    path at least and never adds links, so rounds grow with the logarithm of the longest path. Joins
    are on a vertex, whose links AQE may split.
    """
    now = tables.stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    digest = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.hash("b", "a").cast("long"))).first()
        if tuple(seen) == digest or not seen[0]:
            break
        digest = tuple(seen)
        now = tables.stored(_small_star(_large_star(now)), "links")
    roots = now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(roots)
