"""URL filters: rules by host and path, and for all other urls logistic regression on character n-grams.

A rule fits its host and all subdomains of it, for urls whose path starts with the rule's path; of
several the longest wins. Urls that no rule fits are judged by a model trained from a small table of
labelled urls: n-grams of host and of path, apart from each other, are hashed into SLOTS weights.

Without a table of their own, labels come from the rules: the urls they allow or block, of which those
with the smallest hashes are taken, at most PER_VERDICT of either. Host and path follow the first
`://`; a null url, or one without it, has an empty host and path and fits no rule. Null, equal and
repeated ids are judged row by row. Without labels of both kinds the model allows everything.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 1 << 16
SIZES = (2, 3, 4)
PER_VERDICT = 1_000
ROUNDS, RATE, PENALTY = 200, 0.5, 1e-3


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, like `net/`, and its verdict; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.host + rule.path).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def features(host: str, path: str) -> np.ndarray:
    """Slots of the n-grams of the host, between borders, and of the path; each once."""
    found = set()
    for mark, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        data = text.encode()
        for size in SIZES:
            found.update(zlib.crc32(data[k : k + size], ord(mark)) % SLOTS for k in range(len(data) - size + 1))
    return np.fromiter(sorted(found), np.int64, len(found))


def train(rows: Sequence[tuple[str, str, int]]) -> np.ndarray | None:
    """Weights, the constant last, from hosts, paths and labels (1: block); None without both labels."""
    y = np.array([r[2] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return None
    each = [features(host, path) for host, path, _ in rows]
    row, slot = np.repeat(np.arange(len(rows)), [len(f) for f in each]), np.concatenate(each)
    scale = 1 / np.sqrt(np.bincount(row, minlength=len(rows)).clip(1))
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, constant, past = np.zeros(SLOTS), 0.0, np.full(SLOTS, 1e-8)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(scale * np.bincount(row, w[slot], len(rows)) + constant, -30, 30)))
        error = weight * (p - y)
        slope = np.bincount(slot, (error * scale)[row], SLOTS) + PENALTY * w / len(rows)
        past += slope * slope
        w -= RATE * slope / np.sqrt(past)
        constant -= error.sum()
    return np.append(w, constant)


def labelled_by_rules(pages: DataFrame, rules: Sequence[Rule] = RULES, per_verdict: int = PER_VERDICT) -> DataFrame:
    """url and label (1: block) of at most per_verdict distinct urls of either verdict."""
    verdict = ruled(host_of(F.col("url")), path_of(F.col("url")), rules)[1]
    found = pages.select("url", (verdict == "block").cast("int").alias("label")).where("label IS NOT NULL")
    few = [found.where(F.col("label") == k).distinct().orderBy(F.xxhash64("url"), "url").limit(per_verdict) for k in (0, 1)]
    return few[0].unionByName(few[1])


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of a block, for urls without a rule) of all pages.

    ``labelled`` is a small table of url and label (1: block), which is collected.
    """
    url = F.col("url").cast("string")
    known = labelled_by_rules(pages, rules) if labelled is None else labelled
    known = known.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "label").orderBy("host", "path", "label")
    weights = train([tuple(r) for r in known.collect()])
    parts = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    parts = parts.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict"))
    model = pages.sparkSession.sparkContext.broadcast(weights)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            scores: list[float | None] = [None] * batch.num_rows
            verdicts = batch.column("verdict").to_pylist()
            for n, (host, path, own) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), verdicts, strict=True)):
                if own is None:
                    slots = features(host, path)
                    logit = w[slots].sum() / np.sqrt(max(len(slots), 1)) + w[-1] if w is not None else -30.0
                    scores[n] = float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))
                    verdicts[n] = "block" if scores[n] >= 0.5 else "allow"
            columns = [batch.column(c) for c in ("page_id", "host", "path", "rule")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    kind = dict(pages.select("page_id").dtypes)["page_id"]
    return parts.mapInArrow(judged, f"page_id {kind}, host string, path string, rule string, verdict string, score double")
