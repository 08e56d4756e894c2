"""Cleaners on golden strings, and row by row against plain Python on random text."""

import html
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from opinara.functions import cleaning


def run(spark, function, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["c"] for r in rows.select("i", function(F.col("t")).alias("c")).orderBy("i").collect()]


GOLDEN = [
    ("A <i>slanted</i> word", "A slanted word"),
    ("Look at https://shop.test/a?b=1 there", "Look at there"),
    ("try WWW.SHOP.TEST/x today", "Try today"),
    ("photo imageidQ7-w_2 attached", "Photo attached"),
    ("a VideoIDx- end", "A - end"),
    ("Key 0123456789abcdef0123456789 stop", "Key stop"),
    ("brief 0123456789ab stop", "Brief 0123456789ab stop"),
    ("Case 01234567-89ab-cdef-0123-456789abcdef closed", "Case closed"),
    ("arrived late. box was wet. kept it", "Arrived late. Box was wet. Kept it"),
    ("one. . two.  three.four", "One. . Two. Three.four"),
    ("", None),
    ("   ", None),
    ("<br>", None),
    (None, None),
    ("gaps   much \t over", "Gaps much over"),
    ("5 &gt; 3 &amp; 2 &lt; 4", "5 > 3 & 2 < 4"),
    ("thé0123456789abcdef0123456789", "Thé0123456789abcdef0123456789"),
    ("ßeta. été", "SSeta. été"),
    ("a\u0007b\u0085c", "A b c"),
]


def test_inference_cleaner_golden(spark):
    got = run(spark, cleaning.clean_for_inference, [t for t, _ in GOLDEN])
    assert got == [want for _, want in GOLDEN]


def test_blank_falls_back_to_raw(spark):
    assert run(spark, cleaning.clean_or_raw, ["<br>", "fine"]) == ["<br>", "Fine"]


def test_training_cleaner_golden(spark):
    cases = [
        ("Sooooo GOOOOD!!!!! really???", "soo good!! really??"),
        ("well..... ok,,, a---b ;;", "well. ok, a-b ;"),
        ("ＡＢＣ ﬁne", "abc fine"),
        ("zero​width", "zero width"),
        ("see video_idAB1 and image-id99", "see and"),
        ("HTTPS://UPPER.example stays", "https://upper.example stays"),
        ("a", None),
        ("", None),
        (None, None),
    ]
    assert run(spark, cleaning.clean_for_training, [t for t, _ in cases]) == [want for _, want in cases]
    kept = run(spark, lambda t: cleaning.clean_for_training(t, lowercase=False, min_len=1), ["A", "Wow!!!"])
    assert kept == ["A", "Wow!!"]


def test_strict_cleaner_golden(spark):
    cases = [("Wow!!! \U0001f600❤ yes???", "wow! yes?"), ("\U0001f600", None), ("fine", "fine")]
    assert run(spark, cleaning.clean_strict, [t for t, _ in cases]) == [want for _, want in cases]


def test_emoji(spark):
    assert run(spark, cleaning.has_emoji, ["a \U0001f600", "plain", None, "☀"]) == [True, False, False, True]


ALPHABET = st.sampled_from(list("abAB09.!,-_<>&;:/ \t\n é \x1cİſ") + [
    "http://", "HTTPS://", "www.", "videoid", "image_id", "ImageId", "aabbccddeeff00112233", "&amp;", "&lt", "<b>",
    "550e8400-e29b-41d4-a716-446655440000", "​", "!!!", "ooo", "Ａ", "\U0001f600",
])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=14).map("".join), min_size=80, max_size=80))
def test_removals_agree_with_python_patterns(spark, texts):
    """Each pattern, alone, removes what Python's Unicode-aware engine removes."""
    pairs = [
        (cleaning.URL_ANY_CASE, re.compile(r"https?://\S+|www\.\S+", re.I)),
        (cleaning.URL, re.compile(r"https?://\S+|www\.\S+")),
        (cleaning.MEDIA_ID, re.compile(r"\b(?:video|image)id[a-zA-Z0-9_-]+\b", re.I)),
        (cleaning.MEDIA_ID_SEPARATED, re.compile(r"\b(?:video|image)[_-]?id[a-zA-Z0-9_-]+\b", re.I)),
        (cleaning.LONG_HEX, re.compile(r"\b[a-fA-F0-9]{20,}\b")),
        (cleaning.SPACES, re.compile(r"\s+")),
    ]
    columns = [F.regexp_replace("t", java, " ").alias(f"c{i}") for i, (java, _) in enumerate(pairs)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for row in rows.select("t", *columns, cleaning.unescape(F.col("t")).alias("u"), cleaning.normalise(F.col("t")).alias("n")).collect():
        for i, (_, python) in enumerate(pairs):
            assert row[f"c{i}"] == python.sub(" ", row["t"]), (i, row["t"])
        assert row["u"] == html.unescape(row["t"])
        assert row["n"] == html.unescape(unicodedata.normalize("NFKC", row["t"]))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=14).map("".join), min_size=60, max_size=60))
def test_shortcuts_change_nothing(spark, texts):
    """The cheap tests in front of the patterns never hide a match."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    plain = F.col("t")
    for pattern in (cleaning.URL_ANY_CASE, cleaning.TAG, cleaning.MEDIA_ID, cleaning.LONG_HEX):
        plain = F.regexp_replace(plain, pattern, " ")
    guarded = cleaning._without_noise(F.col("t"), cleaning.URL_ANY_CASE, cleaning.MEDIA_ID)
    assert rows.select(plain.alias("a"), guarded.alias("b")).filter("a != b").isEmpty()
