"""The review feed: filters, pages, single reviews."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.operators.ranking import with_position
from opinara.operators.reports import in_batch

SHALLOW_ROWS = 10_000
MAX_PAGE = 100


def conjunction(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def feed_filter(
    reviews: DataFrame,
    batch_id: str,
    sentiment: str = "",
    category: str = "",
    issue_tag: str = "",
    date_from: str = "",
    date_to: str = "",
    min_confidence: float = 0.0,
) -> DataFrame:
    """All given filters at once; blanks filter nothing. Days compare as strings, both ends included."""
    conditions = [
        F.col(name) == value
        for name, value in (("sentiment", sentiment), ("category", category), ("issue_tag", issue_tag))
        if value
    ]
    if date_from:
        conditions.append(F.col("review_date") >= date_from)
    if date_to:
        conditions.append(F.col("review_date") <= date_to)
    if min_confidence > 0:
        conditions.append(F.col("confidence_margin") >= min_confidence)
    return in_batch(reviews, batch_id).filter(conjunction(conditions))


def newest_first() -> list[Column]:
    return [F.desc(F.coalesce("review_date", F.lit(""))), F.asc("review_id")]


def feed_page(filtered: DataFrame, page: int = 1, limit: int = 20, shallow_rows: int = SHALLOW_ROWS) -> DataFrame:
    """One page, newest first, with ``total`` and ``total_pages``.

    Early pages are a top-k. For a deep page a count per day finds the days it touches (at most
    ``limit`` of them); only those are sorted, by range, so neither the pages before it nor a
    crowded day end up in one task.
    """
    if page < 1 or not 1 <= limit <= MAX_PAGE:
        raise ValueError("page starts at 1 and limit lies in 1..100")
    start = (page - 1) * limit
    if start + limit <= shallow_rows:
        total = filtered.count()
        rows = filtered.orderBy(*newest_first()).limit(start + limit).offset(start)
    else:
        day = F.coalesce("review_date", F.lit(""))
        days = filtered.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
        newest = Window.orderBy(F.desc("_day"))
        upto = F.sum("_n").over(newest.rowsBetween(Window.unboundedPreceding, 0))
        everything = F.sum("_n").over(Window.partitionBy())
        touched = (
            days.withColumns({"_upto": upto, "_all": everything})
            .filter((F.col("_upto") > start) & (F.col("_upto") - F.col("_n") < start + limit))
            .orderBy("_upto")
            .limit(limit)
            .collect()
        )
        if not touched:
            return feed_page(filtered, 1, limit).filter(F.lit(False))
        total = touched[0]["_all"]
        skipped = touched[0]["_upto"] - touched[0]["_n"]
        on_days = filtered.filter(day.isin([row["_day"] for row in touched]))
        placed = with_position(on_days, *newest_first(), name="_at")
        local = start - skipped
        rows = placed.filter((F.col("_at") > local) & (F.col("_at") <= local + limit)).drop("_at")
        rows = rows.orderBy(*newest_first())
    pages = -(-total // limit)
    return rows.withColumns({"total": F.lit(total).cast("long"), "total_pages": F.lit(pages).cast("long")})


def feed_after(filtered: DataFrame, last_date: str | None, last_id, limit: int = 20) -> DataFrame:
    """The page after a known row: constant cost at any depth."""
    day = F.coalesce("review_date", F.lit(""))  # reviews without a date come last
    later = (day < (last_date or "")) | ((day == (last_date or "")) & (F.col("review_id") > last_id))
    return filtered.filter(later).orderBy(*newest_first()).limit(limit)


def feed_by_margin(filtered: DataFrame, limit: int, ascending: bool = False) -> DataFrame:
    first = F.asc("confidence_margin") if ascending else F.desc("confidence_margin")
    return filtered.orderBy(first, "review_id").limit(limit)


def get_review(reviews: DataFrame, review_id, batch_id: str) -> DataFrame:
    """The review, or no row when it belongs to another batch."""
    return in_batch(reviews, batch_id).filter(F.col("review_id") == review_id)


def flatten_extra(reviews: DataFrame, keys: list[str], extra: str = "extra") -> DataFrame:
    """Extra values as columns; where one shares a base column's name, the extra value wins."""
    base = [name for name in reviews.columns if name != extra]
    held = {key: F.try_element_at(F.col(extra), F.lit(key)) for key in keys}
    shown = [
        F.coalesce(held[name], F.col(name).cast("string")).alias(name) if name in held else F.col(name) for name in base
    ]
    return reviews.select(*shown, *[value.alias(key) for key, value in held.items() if key not in base])


def category_in(df: DataFrame, values: list[str], column: str = "category") -> DataFrame:
    return df.filter(F.col(column).isin(values))
