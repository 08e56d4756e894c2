from pyspark.sql import functions as F

from opinara.functions import sentences as S


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("c")).first()["c"]


def test_split(spark):
    assert one(spark, S.sentences(F.col("t")), " One.  Two! Three?four. ") == ["One.", "Two!", "Three?four."]
    assert one(spark, S.sentences(F.col("t")), "  ") == []
    assert one(spark, S.sentences(F.col("t")), None) == []
    assert one(spark, S.sentences(F.col("t")), "A. \nB") == ["A.", "B"]


def test_last_sentences(spark):
    text = "A. B. C. D. E. F."
    assert one(spark, S.last_sentences(F.col("t")), text) == "D. E. F."
    assert one(spark, S.last_sentences(F.col("t")), "A. B. C.") == "A. B. C."
    assert one(spark, S.last_sentences(F.col("t")), None) is None


def test_opinion_score(spark):
    # two opinion words, one pronoun, one exclamation mark over five words
    assert one(spark, S.opinion_score(F.col("t")), "I loved this GREAT film!") == (2 * 2 + 1 + 1.5) / 5
    assert one(spark, S.opinion_score(F.col("t")), "123 456") == 0.0
    long = " ".join(["plot"] * 31)
    assert one(spark, S.opinion_score(F.col("t")), long) == -1.0 / 31


def test_top_opinions_keep_order_and_repeats(spark):
    text = "Plot here. I love it! More plot. I love it! Worst ending. Great cast. The end."
    assert one(spark, S.top_opinions(F.col("t"), k=3), text) == "I love it! I love it! Worst ending."
    # equal scores: the earlier sentence wins
    flat = "aa. bb. cc. dd. ee. ff."
    assert one(spark, S.top_opinions(F.col("t"), k=2), flat) == "aa. bb."
    assert one(spark, S.top_opinions(F.col("t")), "Short. Text.") == "Short. Text."
