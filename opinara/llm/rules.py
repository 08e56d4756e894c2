r"""Quality rules as a short-circuit cascade of column expressions; no Python runs on the rows.

Words are runs of anything but the six ASCII blanks, over the whole text. Every rule rejects on counts
taken from the text. Its cost (time for the rows of a sample) and what it rejects are measured on a
sample; rules are then ordered by rejection per cost, each against the rows that the rules before it
leave, and a row is judged by a nested CASE, which stops at the first rule that rejects it. The order
decides how much is computed, never the verdict.

Null and empty texts have no words and fail the word count. Ids are not looked at: null, equal and
repeated ones are judged like any other. Trigrams are compared by 64-bit hashes within one text. An
empty table gives no rows, and the cascade keeps the given order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm import tables

BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 500
Counts = Callable[[str], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it, and only if needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return let(
        F.trim(text, F.lit(BLANKS)),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"[\x20\x09-\x0D]+")),
    )


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three that the text has twice or more, first windows included."""
    windows = F.transform(F.slice(words, 1, F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(sorted_windows: Column) -> Column:
        twin = lambda x, i: F.coalesce(F.get(sorted_windows, i)["h"] == x["h"], F.lit(False))
        repeated = F.filter(sorted_windows, lambda x, i: twin(x, i - 1) | twin(x, i + 1))
        places = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        # Between two windows as many words are covered as lie between their starts, three at most.
        return let(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def count(hashes: Column) -> Column:
        numbered = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.sort_array(numbered), covered))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, count))


def without(text: Column, symbols: str) -> Column:
    for symbol in symbols:
        text = F.replace(text, F.lit(symbol), F.lit(""))
    return text


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != "")


def counts_of(text: Column, words: Column) -> dict[str, Column]:
    """What rules look at, each an expression of its own that costs nothing unless it is used."""
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.char_length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.octet_length(text) - F.octet_length(without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": let(lines_of(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words).cast("long"),
        "n_lines": F.size(lines_of(text)).cast("long"),
        "n_exclaims": (F.octet_length(text) - F.octet_length(without(text, "!"))).cast("long"),
    }


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Counts], Column]


BASE = (
    Rule("few_words", lambda n: n("n_words") < 50),
    Rule("repeats", lambda n: 100 * n("n_repeat_words") > 50 * n("n_words")),
)
RULES = (
    *BASE,
    Rule("symbols", lambda n: 100 * n("n_symbols") > 10 * n("n_words")),
    Rule("exclaims", lambda n: 100 * n("n_exclaims") > 30 * n("n_words")),
    Rule("duplicate_lines", lambda n: 100 * n("n_dup_lines") > 50 * n("n_lines")),
    Rule("word_length", lambda n: (n("word_chars") < 2 * n("n_words")) | (n("word_chars") > 14 * n("n_words"))),
)


def _judged(text: Column, rules: Sequence[Rule], verdict: Callable[[list[Column]], Column]) -> Column:
    return let(text, lambda t: let(words_of(t), lambda w: verdict([r.rejects(counts_of(t, w).__getitem__) for r in rules])))


def by_gain(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order of rejections per second on a sample of the documents."""
    sample = docs.select(tables.text_of(text).alias("text")).sample(0.05, 7).limit(rows)
    sample = tables.stored(sample, "rule-sample")
    own = F.col("text")
    verdicts = sample.select(_judged(own, rules, lambda found: F.array(*found)).alias("v")).collect()

    def seconds(rule: Rule) -> float:
        timed = sample.select(F.count_if(_judged(own, [rule], lambda found: found[0])).alias("n"))
        took = []
        for _ in range(2):
            began = time.perf_counter()
            timed.collect()
            took.append(time.perf_counter() - began)
        return min(took)

    idle = seconds(Rule("none", lambda n: n("n_words") < 0))
    cost = {r.name: max(seconds(r) - idle, 1e-3) for r in rules}
    left, order, rest = [row.v for row in verdicts], [], list(range(len(rules)))
    while rest:
        best = max(rest, key=lambda k: (sum(v[k] for v in left) / cost[rules[k].name], -cost[rules[k].name]))
        order.append(best)
        rest.remove(best)
        left = [v for v in left if not v[best]]
    return [rules[k] for k in order]


def rejected_by(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The first of the rules that rejects the text, null if none does; later ones aren't computed."""

    def first(found: list[Column]) -> Column:
        out = F.lit(None).cast("string")
        for rule, rejects in reversed(list(zip(rules, found, strict=True))):
            out = F.when(rejects, F.lit(rule.name)).otherwise(out)
        return out

    return _judged(text, rules, first)


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents that no rule rejects, with the columns they have."""
    return docs.where(rejected_by(tables.text_of(), by_gain(docs, rules)).isNull())


def report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, all counts, base_failed and kept of every document."""
    extra = [r for r in rules if r not in BASE]
    ordered = by_gain(docs, extra) if extra else []

    def all_counts(text: Column) -> Column:
        return let(text, lambda t: let(words_of(t), lambda w: F.struct(*[c.alias(k) for k, c in counts_of(t, w).items()])))

    counted = docs.select(F.col("doc_id"), all_counts(tables.text_of()).alias("n"))
    n = lambda name: F.col("n")[name]
    failed = F.lit(False)
    for rule in BASE:
        failed = failed | rule.rejects(n)
    kept = F.lit(True)
    for rule in reversed(ordered):
        kept = F.when(rule.rejects(n), F.lit(False)).otherwise(kept)
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return counted.select("doc_id", *[n(c).alias(c) for c in columns], failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(kept).alias("kept"))


REPORT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
counts AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines,
    length(t) - length(replace(t, '!', '')) AS n_exclaims, coalesce(n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (r)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_exclaims > 30 * n_words
    OR 100 * n_dup_lines > 50 * n_lines OR word_chars < 2 * n_words OR word_chars > 14 * n_words) AS kept
FROM judged
"""
