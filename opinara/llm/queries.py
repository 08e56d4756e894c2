"""The queries of this package, by the names the driver checks, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import decontamination, encoding, lattice, lexical, packing, periodic, quality, rules, sharding, simhash, tables, token_files, toxicity, urls, warc

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(tables.table(spark, sf_dir, "documents"), encoding.tokenizer_file("byte_bpe_50k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels")).drop("row")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(tables.table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(tables.table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(tables.table(spark, sf_dir, "documents"), encoding.tokenizer_file("word_bpe_49k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(tables.table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(tables.table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(tables.table(spark, sf_dir, "pages"))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(periodic.with_loops(tables.table(spark, sf_dir, "documents"))))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "benchmark"))


def op13_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.classes(tables.table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_token_files": op7_token_files,
    "op8_sharding": op8_sharding,
    "op9_url_filters": op9_url_filters,
    "op10_warc": op10_warc,
    "op11_periodic": op11_periodic,
    "op12_lexical": op12_lexical,
    "op13_lattice": op13_lattice,
}
ORACLES: dict[str, str] = {
    "op5_quality_rules": rules.REPORT_SQL,
    "op10_warc": warc.ARCHIVE_SQL,
    "op12_lexical": lexical.SEARCH_SQL,
}
