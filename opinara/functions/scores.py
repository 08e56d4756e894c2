"""Per-row score expressions: margins, decision rules, label codes, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.schema import LABELS, NEGATIVE_MARGIN, POSITIVE_MARGIN, UNCERTAIN_MARGIN


def probabilities(prefix: str = "prob_") -> Column:
    return F.array(*[F.col(f"{prefix}{label}") for label in LABELS])


def margin(probs: Column) -> Column:
    """Best minus second-best probability."""
    ranked = F.sort_array(probs, asc=False)
    return ranked[0] - ranked[1]


def argmax(probs: Column) -> Column:
    """Class id of the largest entry; ties go to the lowest id."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def asymmetric_rule(
    predicted: Column, lead: Column, positive: Column | float = POSITIVE_MARGIN, negative: Column | float = NEGATIVE_MARGIN
) -> Column:
    """Unsure positives become neutral; negatives only below their own, stricter margin."""
    unsure = ((predicted == 2) & (lead < positive)) | ((predicted == 0) & (lead < negative))
    return F.when(unsure, 1).otherwise(predicted)


def symmetric_rule(predicted: Column, lead: Column, threshold: Column | float) -> Column:
    return F.when(lead < threshold, 1).otherwise(predicted)


def margin_bucket(lead: Column, threshold: float = UNCERTAIN_MARGIN) -> Column:
    return F.when(lead <= threshold, "uncertain").when(lead > threshold, "confident")


def softmax(logits: Column) -> Column:
    exps = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(exps, lambda x: x / total)


def l2_normalise(vector: Column, floor: float = 1e-9) -> Column:
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    norm = F.greatest(F.sqrt(squares), F.lit(floor))
    return F.transform(vector, lambda x: x.cast("double") / norm)


def label_id(name: Column) -> Column:
    return _lookup(name, {label: i for i, label in enumerate(LABELS)})


def label_name(code: Column) -> Column:
    return _lookup(code, dict(enumerate(LABELS)))


def _lookup(column: Column, pairs: dict) -> Column:
    choice = None
    for key, value in pairs.items():
        choice = F.when(column == key, value) if choice is None else choice.when(column == key, value)
    return choice


def label_from_stars(stars: Column) -> Column:
    """1-2 stars negative, 3 neutral, 4-5 positive."""
    return F.when(stars.between(1, 2), "negative").when(stars == 3, "neutral").when(stars.between(4, 5), "positive")


def tag_title(tag: Column) -> Column:
    return F.replace(tag, F.lit("_"), F.lit(" "))


def shorten(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def number_or_zero(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))
