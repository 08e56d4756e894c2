"""Human corrections: merging, listing, and the trust gates in front of retraining.

Votes are grouped per session or per review before any join, so one very busy session or
review arrives at the join as a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.functions.scores import number_or_zero
from opinara.operators.ranking import small_side
from opinara.schema import HIGH_CONFIDENCE, LABELS, MIN_CORRECTIONS, MIN_SESSIONS, SESSION_DOMINANCE, SESSION_MIN_VOTES
from opinara.session import cut


def invalid_labels(df: DataFrame, column: str = "manual_label") -> DataFrame:
    """Rows whose label lies outside the domain; a job should stop when there are any."""
    return df.filter(F.col(column).isNull() | ~F.col(column).isin(*LABELS))


def session(column: str = "session_id") -> Column:
    """Blank sessions count as none."""
    return F.nullif(F.col(column), F.lit(""))


def merge_corrections(incoming: DataFrame, existing: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert corrections per (review, session); returns (corrections, rejects).

    Every vote is judged by itself: unknown reviews and votes equal to the predicted label are
    rejected and change nothing. Of a session's accepted votes the latest wins. A vote without a
    session replaces the first existing correction of its review. Text, label and margin always
    come from the review.
    """
    known = reviews.select(
        F.col("review_id"),
        F.col("batch_id").alias("r_batch"),
        F.col("text").alias("r_text"),
        F.col("sentiment").alias("r_label"),
        F.col("confidence_margin").alias("r_margin"),
    )
    votes = incoming.select("review_id", F.coalesce("session_id", F.lit("")).alias("session_id"), "manual_label", "date")
    # Counted alike votes meet the reviews once; the counts bring rejected ones back one by one.
    alike = votes.groupBy("review_id", "session_id", "manual_label", "date").agg(F.count(F.lit(1)).alias("votes"))
    no_op = F.col("manual_label") == F.col("r_label")
    judged = cut(
        alike.join(known, "review_id", "left").withColumn(
            "reason", F.when(F.col("r_label").isNull(), "NOT_FOUND").when(no_op, "NO_OP")
        )
    )
    rejects = judged.filter("reason IS NOT NULL").select(
        "review_id", "session_id", "manual_label", "date", "reason", F.explode(F.sequence(F.lit(1), "votes")).alias("_n")
    )
    rejects = rejects.drop("_n")
    last = F.max_by(F.struct("manual_label", "date"), F.struct("date", "manual_label"))
    fields = ["r_batch", "r_text", "r_label", "r_margin"]
    accepted = judged.filter("reason IS NULL").groupBy("review_id", "session_id").agg(
        last.alias("v"), *[F.any_value(name).alias(name) for name in fields]
    )

    first_id = F.min_by("correction_id", F.struct("date", "correction_id"))
    by_session = (
        existing.filter("session_id != ''").groupBy("review_id", "session_id").agg(first_id.alias("same_session"))
    )
    by_review = existing.groupBy("review_id").agg(first_id.alias("any_session"))
    target = F.when(F.col("session_id") != "", F.col("same_session")).otherwise(F.col("any_session"))
    fresh = F.md5(F.concat_ws(":", F.col("review_id").cast("string"), "session_id"))
    incoming_rows = (
        accepted.join(by_session, ["review_id", "session_id"], "left")
        .join(by_review, "review_id", "left")
        .select(
            F.coalesce(target, fresh).alias("correction_id"),
            "review_id",
            F.col("r_batch").alias("batch_id"),
            F.col("r_text").alias("text"),
            F.col("r_label").alias("label"),
            F.col("v.manual_label").alias("manual_label"),
            F.col("v.date").alias("date"),
            "session_id",
            F.col("r_margin").alias("confidence_margin"),
        )
    )
    whole = F.struct(*[F.col(name) for name in incoming_rows.columns])
    order = F.struct("date", "session_id")
    winners = incoming_rows.groupBy("correction_id").agg(F.max_by(whole, order).alias("row")).select("row.*")
    kept = existing.select(*winners.columns).join(winners, "correction_id", "left_anti")
    return kept.unionByName(winners), rejects


def with_review_fields(corrections: DataFrame, reviews: DataFrame) -> DataFrame:
    """Corrections with the review's margin and category; without a match they keep their own margin."""
    fields = reviews.select(
        F.col("review_id"), F.col("confidence_margin").alias("r_margin"), F.col("category").alias("category")
    )
    joined = corrections.join(fields, "review_id", "left")
    return joined.withColumn("confidence_margin", F.coalesce("r_margin", "confidence_margin")).drop("r_margin")


def correction_totals(corrections: DataFrame) -> DataFrame:
    return corrections.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct(F.nullif(F.col("batch_id"), F.lit(""))).alias("batch_count")
    )


def correction_list(
    corrections: DataFrame, original: str = "all", corrected: str = "all", sort_by: str = "date", ascending: bool = True
) -> DataFrame:
    if original != "all":
        corrections = corrections.filter(F.col("label") == original)
    if corrected != "all":
        corrections = corrections.filter(F.col("manual_label") == corrected)
    key = F.coalesce(F.col(sort_by), F.lit(""))
    return corrections.orderBy(key.asc() if ascending else key.desc(), "correction_id")


def session_dominance(votes: DataFrame) -> DataFrame:
    """Votes per session and the share of its most frequent label; sessionless votes are left out."""
    per_label = (
        votes.withColumn("session_id", session())
        .filter("session_id IS NOT NULL")
        .groupBy("session_id", "manual_label")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    labelled = F.sum(F.when(F.col("manual_label").isNotNull(), F.col("n")))
    leader = F.max(F.when(F.col("manual_label").isNotNull(), F.col("n")))
    return per_label.groupBy("session_id").agg(
        F.sum("n").cast("long").alias("votes"), (leader / labelled).alias("dominant_ratio")
    )


def suspicious_sessions(
    votes: DataFrame, min_votes: int = SESSION_MIN_VOTES, dominance: float = SESSION_DOMINANCE
) -> DataFrame:
    return session_dominance(votes).filter((F.col("votes") >= min_votes) & (F.col("dominant_ratio") > dominance))


def flag_sessions(votes: DataFrame, **limits) -> DataFrame:
    """Votes with ``suspicious``: does the vote come from an excluded session?"""
    flagged = small_side(suspicious_sessions(votes, **limits).select(F.col("session_id").alias("_flagged")))
    keyed = votes.withColumn("session_id", session())
    joined = keyed.join(flagged, keyed["session_id"] == flagged["_flagged"], "left")
    return joined.withColumn("suspicious", F.col("_flagged").isNotNull()).drop("_flagged")


def volume_gate(votes: DataFrame, minimum: int = MIN_CORRECTIONS) -> DataFrame:
    """Are there enough corrections, before and after dropping suspicious sessions?"""
    return flag_sessions(votes).agg(
        F.count(F.lit(1)).alias("loaded"),
        F.count_if(~F.col("suspicious")).alias("remaining"),
        (F.count(F.lit(1)) >= minimum).alias("enough_loaded"),
        (F.count_if(~F.col("suspicious")) >= minimum).alias("enough_remaining"),
    )


def sessions_per_review(votes: DataFrame) -> DataFrame:
    return votes.groupBy("review_id").agg(F.count_distinct(session()).alias("sessions"))


def ballots(flagged_votes: DataFrame, order: list[str], carry: list[str]) -> DataFrame:
    """One row per review: kept votes, sessions, majority, tie, and first values in a stated order."""
    kept = ~F.col("suspicious")
    per_label = [F.count_if(kept & (F.col("manual_label") == label)).alias(f"n_{label}") for label in LABELS]
    firsts = [F.min_by(F.when(kept, F.col(c)), F.when(kept, F.struct(*order))).alias(c) for c in carry]
    counted = flagged_votes.groupBy("review_id").agg(
        F.count_if(kept).alias("votes"),
        F.count_distinct(F.when(kept, F.col("session_id"))).alias("sessions"),
        *per_label,
        *firsts,
    )
    ranked = F.sort_array(
        F.array(*[F.struct(F.col(f"n_{label}").alias("n"), F.lit(label).alias("label")) for label in LABELS]), asc=False
    )
    return counted.withColumn("_ranked", ranked).select(
        "review_id",
        "votes",
        "sessions",
        *carry,
        F.col("_ranked")[0]["label"].alias("majority"),
        ((F.col("_ranked")[0]["n"] == F.col("_ranked")[1]["n"]) & (F.col("_ranked")[0]["n"] > 0)).alias("tie"),
    )


def route(
    reviews_voted: DataFrame, known_ids: DataFrame, min_sessions: int = MIN_SESSIONS, high: float = HIGH_CONFIDENCE
) -> DataFrame:
    """What happens to each ballot. ``known_ids`` has one ``review_id`` per training text."""
    known = known_ids.select("review_id", F.lit(True).alias("known"))
    margin = number_or_zero(F.col("confidence_margin").cast("string"))
    status = (
        F.when(F.col("votes") == 0, "excluded_session")
        .when(F.col("sessions") < min_sessions, "deferred_volume")
        .when(F.col("tie"), "excluded_tie")
        .when(F.col("known") & (margin > high), "applied_flagged")
        .when(F.col("known"), "applied")
        .otherwise("new_text")
    )
    routed = reviews_voted.join(known, "review_id", "left").withColumn("status", status)
    decided = F.col("status").isin("applied", "applied_flagged", "new_text")
    return routed.withColumn("new_label", F.when(decided, F.col("majority"))).drop("known")


def trust_summary(routed: DataFrame) -> DataFrame:
    return routed.groupBy("status").agg(F.count(F.lit(1)).alias("reviews"))


def apply_verdicts(dataset: DataFrame, routed: DataFrame) -> DataFrame:
    """Relabel training rows only; verdicts on other splits are reported in ``outcome``.

    ``dataset`` has review_id, label and split.
    """
    verdicts = routed.filter(F.col("status").isin("applied", "applied_flagged")).select("review_id", "new_label")
    joined = dataset.join(verdicts, "review_id", "left")
    trains = F.col("split") == "train"
    outcome = F.when(F.col("new_label").isNull(), "untouched").when(trains, "relabelled").otherwise("blocked")
    label = F.when(trains, F.coalesce("new_label", "label")).otherwise(F.col("label"))
    return joined.withColumns({"outcome": outcome, "label": label}).drop("new_label")


def new_training_rows(routed: DataFrame) -> DataFrame:
    """Accepted texts that no data set holds yet; they may only ever train."""
    return routed.filter("status = 'new_text'").select(
        F.concat(F.lit("new_"), F.col("review_id").cast("string")).alias("id"),
        F.col("new_label").alias("label"),
        F.lit("train").alias("split"),
    )
