"""Hashed terms and the tidying of plain texts against Spark's own stages and patterns."""

from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from opinara.functions import cleaning, terms
from opinara.operators import scoring

WIDTH = 64


def characters(spark):
    """Characters of two bytes, and some of those beyond, between letters, and first and last."""
    points = spark.range(0x20000).where("(id < 55296 OR id > 57343) AND (id < 65536 OR id % 16 = 0)")
    held = points.select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    return held.select("id", F.concat(F.lit("ab"), "c", F.lit("De. x. y X"), "c", "c").alias("text")).repartition(8)


def by_spark(docs, width=WIDTH):
    words = RegexTokenizer(inputCol="text", outputCol="_w", pattern=terms.BREAK, minTokenLength=2).transform(docs)
    counted = HashingTF(inputCol="_w", outputCol="want", numFeatures=width).transform(words)
    return counted.withColumn("want", vector_to_array("want")).drop("_w")


def test_counts_are_those_of_sparks_stages(spark, folder):
    words = "one Two, three_3 ÄÖ ß İI ΣΑΣ 中文 x 1 22 " + "long" * 200 + " \U0001d400 " + "ü" * 150
    odd = spark.createDataFrame([(k, words[k:]) for k in range(0, len(words), 7)], "id long, text string")
    given = spark.read.parquet(f"{folder}/documents.parquet").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    for docs, width in ((characters(spark), WIDTH), (odd, 77), (odd, terms.DENSE + 1), (given, 64)):
        got = scoring.hashed_terms("text", width).transform(by_spark(docs, width)).withColumn("got", vector_to_array("_tf"))
        assert got.where(~F.col("got").eqNullSafe(F.col("want"))).isEmpty()


def test_most_texts_are_counted_by_numpy(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("text").where("text IS NOT NULL")
    assert docs.where(terms.hashed_counts(64)(F.col("text")).isNull()).isEmpty()


def test_counts_that_are_there_are_kept(spark):
    docs = spark.createDataFrame([("good good phone",), (None,), ("bad",)], "text string")
    counted = scoring.with_terms(docs, width=16)
    want = scoring.vectorise(docs, scoring.text_vectoriser(docs, width=16)).collect()
    made = scoring.vectorise(counted, scoring.text_vectoriser(counted, width=16))
    got = made.drop("_tf").collect()
    assert made.columns == ["text", "_tf", "features"]
    assert sorted(got, key=str) == sorted(want, key=str)


def by_patterns(text):
    tidy = cleaning._without_any_noise(text)
    return F.when(F.length(tidy) > 0, cleaning._upper_first(tidy))


def test_tidied_texts_are_those_of_the_patterns(spark):
    c = F.substring("text", 3, 1)
    shapes = F.array(
        "text", c, F.concat(F.lit("v"), c, F.lit("deoid-x a. b. .  c"), c, F.lit(". d. ")), F.concat(c, F.lit("mageidQ"), c), F.concat(F.lit("ww"), c, F.lit(".abc httpS:"), c, F.lit("/a "))
    )
    docs = characters(spark).select(F.explode(shapes).alias("text"))
    ids = ["0123456789abcdefABCD", "a 550e8400-e29b-41d4-a716-446655440000. b", "x" * 30 + ". y", "deadbeef-0123-4567 z", "", " ", None]
    for rows in (docs, spark.createDataFrame([(t,) for t in ids], "text string")):
        assert rows.where(~cleaning.clean_for_inference(F.col("text")).eqNullSafe(by_patterns(F.col("text")))).isEmpty()


def test_plain_texts_pass_no_patterns():
    assert cleaning._tidied("  arrived\n late.\u0007 box  was wet. éa ") == "arrived late. Box was wet. éa"
    assert cleaning._tidied("see WWW.shop.test") is None and cleaning._tidied("a VİDEOıD7") is None


def test_broken_utf8_is_left_to_the_jvm(spark):
    broken = spark.range(1).select(F.expr("CAST(unhex('616220FF6364') AS STRING)").alias("text"))
    got = broken.select(F.length(cleaning.clean_for_inference(F.col("text"))).alias("n")).first()
    assert got.n == broken.select(F.length(by_patterns(F.col("text"))).alias("n")).first().n
    assert scoring.with_terms(broken, width=16).count() == 1
