"""ISO dates and weeks over string dates, and packed aggregate keys."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions.binding import let
from opinara.schema import FALLBACK_SCOPE, UNKNOWN_WEEK

# The forms that Python's datetime.fromisoformat takes (fixed by the standard): calendar and week
# dates, extended or compact, alone or followed by a separator, a time of day and an offset.
_DAY = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-[1-7])?|\d{4}W\d{2}[1-7]?)"
_CLOCK = r"([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?|[0-5]\d([0-5]\d([.,]\d+)?)?)?"
PLAIN_DATE = r"^\d{4}-\d{2}-\d{2}$"
ISO_DATE = rf"^{_DAY}([^0-9]{_CLOCK}(Z|[+-]\d{{2}}(:?\d{{2}}(:?\d{{2}})?)?)?)?$"


def week_start(label: Column) -> Column:
    """The Monday of a week like 2025-W03 or 2025W03."""
    year, week = F.substring(label, 1, 4).try_cast("int"), F.regexp_extract(label, r"W(\d{2})", 1).try_cast("int")
    first = F.date_trunc("week", F.make_date(year, F.lit(1), F.lit(4))).cast("date")
    return F.date_add(first, (week - 1) * 7)


def _other_form(text: Column) -> Column:
    """The date of an ISO string in any form; each intermediate value is named, so that it is worked out once."""

    def by_week(digits: Column) -> Column:
        label = F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 3))
        weekday = F.coalesce(F.substring(digits, 8, 1).try_cast("int"), F.lit(1))
        # A week that its year doesn't have would be the next year's.
        return let(F.date_add(week_start(digits), weekday - 1), lambda day: F.when((week_of(day) == label) & ~digits.startswith("0000"), day))

    def by_digits(digits: Column) -> Column:
        return F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)).try_cast("date")

    found = F.replace(F.regexp_extract(text, ISO_DATE, 1), F.lit("-"))
    return let(found, lambda digits: F.when(F.contains(digits, F.lit("W")), by_week(digits)).when(digits != "", by_digits(digits)))


def iso_date(text: Column) -> Column:
    """The calendar date of an ISO string, null when blank or invalid."""
    return F.when(F.rlike(text, F.lit(PLAIN_DATE)), text.try_cast("date")).otherwise(_other_form(text))


def week_of(day: Column) -> Column:
    """ISO week label of a date, by year-of-week: 2024-12-30 is 2025-W01."""
    year = F.date_part(F.lit("YEAROFWEEK"), day).cast("string")
    return F.concat(year, F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def week_label(text: Column) -> Column:
    """The ISO week of an ISO string; nearly all are plain dates, whose week is compiled code."""
    plain = F.when(F.rlike(text, F.lit(PLAIN_DATE)), week_of(text.try_cast("date")))
    return F.coalesce(plain.otherwise(let(_other_form(text), week_of)), F.lit(UNKNOWN_WEEK))


def parse_iso(value: str) -> date:
    """Validate one request parameter; the message carries the error code."""
    try:
        return datetime.fromisoformat(value).date()
    except (TypeError, ValueError):
        raise ValueError(f"INVALID_DATE: {value!r}") from None


def week_of_parameter(value: str) -> str:
    year, week, _ = parse_iso(value).isocalendar()
    return f"{year}-W{week:02d}"


PRESET_DAYS = {"7d": 7, "30d": 30, "90d": 90}


def preset_range(preset: str, as_of: date) -> tuple[str, str]:
    """(from, to) for a named window ending at ``as_of``; blanks mean unbounded."""
    if preset not in PRESET_DAYS:
        return "", ""
    return (as_of - timedelta(days=PRESET_DAYS[preset])).isoformat(), as_of.isoformat()


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("#", *[F.coalesce(part, F.lit("")) for part in parts])


def unpack_trend(agg_type: Column) -> Column:
    """struct(category, week) of a TREND key, null for any other shape."""
    parts = F.split(agg_type, "#")
    fits = (F.size(parts) == 3) & (parts[0] == "TREND")
    return F.when(fits, F.struct(parts[1].alias("category"), parts[2].alias("week")))


def unpack_issue(agg_type: Column) -> Column:
    """struct(issue_tag, cluster_source, week); three-part legacy keys get the fallback source."""
    parts = F.split(agg_type, "#")
    is_issue = parts[0] == "ISSUE"

    def shape(source: Column, week: Column) -> Column:
        return F.struct(parts[1].alias("issue_tag"), source.alias("cluster_source"), week.alias("week"))

    return F.when(is_issue & (F.size(parts) == 4), shape(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)))).when(
        is_issue & (F.size(parts) == 3), shape(F.lit(FALLBACK_SCOPE), F.get(parts, F.lit(2)))
    )


def unpack_category(agg_type: Column) -> Column:
    """Category of a CAT key: everything after the first separator."""
    return F.when(agg_type.startswith("CAT#"), F.substring(agg_type, F.lit(5), F.length(agg_type)))
