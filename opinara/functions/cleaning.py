"""Text cleaners as column expressions.

Entity decoding and NFKC need Python; rows that cannot change under them are sent as nulls.
Everything else is a chain of regular expressions, except that the light cleaner tidies texts
without noise by plain string methods in Python, in a fraction of the time of the chain.
Character classes are spelled out because Java's ``\\s``, ``\\w`` and ``\\b`` are ASCII by default.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinara.functions.binding import let

# What counts as space, word character and word boundary.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# The noise patterns, in the order they are removed.
URL = rf"(?U)https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
URL_ANY_CASE = rf"(?iuU)https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
TAG = r"<[^>]+>"
MEDIA_ID = rf"(?iu){EDGE}(?:video|image)id[a-zA-Z0-9_-]+{EDGE}"
MEDIA_ID_SEPARATED = rf"(?iu){EDGE}(?:video|image)[_-]?id[a-zA-Z0-9_-]+{EDGE}"
LONG_HEX = rf"{EDGE}[a-fA-F0-9]{{20,}}{EDGE}"
UUID = rf"{EDGE}[a-fA-F0-9]{{8}}-[a-fA-F0-9]{{4}}-[a-fA-F0-9]{{4}}-[a-fA-F0-9]{{4}}-[a-fA-F0-9]{{12}}{EDGE}"
CONTROL = r"[\x00-\x1f\x7f-\x9f]"
CONTROL_AND_INVISIBLE = r"[\x00-\x1f\x7f-\x9f\u200b\u200e\u200f\ufeff]"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}]+"
STRETCHED_LETTERS = r"([a-zA-Z])\1{2,}"
STRETCHED_EMPHASIS = r"([!?])\1+"
STRETCHED_PUNCTUATION = r"([,.\-;:])\1+"
STRETCHED_ANY = r"([!?,.\-;:])\1+"
SPACES = rf"(?U){SPACE}+"


# What the patterns for ids need, in Python; looked for only in words of at least LONG_WORD characters.
LONG_WORD = 20
MAY_BE_ID = re.compile(r"[a-fA-F0-9]{20}|[a-fA-F0-9]-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-")
CONTROL_IN_PYTHON = re.compile(CONTROL)
OPENED = re.compile(r"\. [a-z]")


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def _normalise(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: html.unescape(unicodedata.normalize("NFKC", text)), na_action="ignore")


def _tidied(text: str) -> str | None:
    """Blanks squeezed and sentences opened in capitals, if none of the noise patterns can match; else None.

    Expects a text without ``&``, ``<`` and ``://``. ``str.split`` parts words at just the characters of ``SPACE``.
    """
    low = text.lower()
    if "ı" in low or "\u0307" in low:  # these stand for an i where case is ignored
        low = low.replace("\u0307", "").replace("ı", "i")
    if "www." in low or "videoid" in low or "imageid" in low:
        return None
    words = text.split()
    if max(map(len, words), default=0) >= LONG_WORD and any(MAY_BE_ID.search(word) for word in words if len(word) >= LONG_WORD):
        return None
    tidy = " ".join(words)
    if not tidy.isprintable():
        tidy = " ".join(CONTROL_IN_PYTHON.sub(" ", tidy).split())
    return OPENED.sub(lambda start: start[0].upper(), tidy)


@F.pandas_udf(T.StringType())
def _tidy(texts: pd.Series) -> pd.Series:
    return texts.map(_tidied, na_action="ignore")


def unescape(text: Column) -> Column:
    """Decode entities; only texts holding an ampersand travel to Python."""
    return F.coalesce(_unescape(F.when(text.contains("&"), text)), text)


def normalise(text: Column) -> Column:
    """NFKC, then entities; plain ASCII without an ampersand is already a fixed point."""
    return F.coalesce(_normalise(F.when(text.rlike(r"[^\x00-\x7f]|&"), text)), text)


def _blank(text: Column, pattern: str, worth_it: Callable[[Column], Column]) -> Column:
    """Blank out a pattern; a cheap test spares most texts the full scan."""
    return let(text, lambda t: F.when(worth_it(t), F.regexp_replace(t, pattern, " ")).otherwise(t))


def _may_hold_url(text: Column) -> Column:
    return text.contains("://") | F.lower(text).contains("www.")


def _may_hold_tag(text: Column) -> Column:
    return text.contains("<")


def _may_hold_media_id(text: Column) -> Column:
    return text.rlike("(?iu)(?:video|image)[_-]?id")


def _may_hold_hex(text: Column) -> Column:
    return text.rlike("[a-fA-F0-9]{20}")


def _may_hold_uuid(text: Column) -> Column:
    return text.rlike("[a-fA-F0-9]-[a-fA-F0-9]{4}-[a-fA-F0-9]{4}-")


def _without_noise(text: Column, url: str, media_id: str) -> Column:
    text = _blank(text, url, _may_hold_url)
    text = _blank(text, TAG, _may_hold_tag)
    text = _blank(text, media_id, _may_hold_media_id)
    return _blank(text, LONG_HEX, _may_hold_hex)


def _squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def _upper_first(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def _open_sentences(text: Column) -> Column:
    """Upper-case ASCII letters that open a piece after a full stop."""
    opened = F.transform(
        F.split(text, r"\. "), lambda piece, i: F.when((i > 0) & piece.rlike("^[a-z]"), _upper_first(piece)).otherwise(piece)
    )
    return F.array_join(opened, ". ")


def _without_any_noise(text: Column) -> Column:
    bare = _blank(_without_noise(unescape(text), URL_ANY_CASE, MEDIA_ID), UUID, _may_hold_uuid)
    return _open_sentences(_squeeze(F.regexp_replace(bare, CONTROL, " ")))


def clean_for_inference(text: Column) -> Column:
    """Light cleaning that keeps case and punctuation; null when nothing is left.

    Texts that may hold noise go through the patterns; all others, most of them, need only be tidied.
    """
    noise = text.contains("&") | text.contains("<") | text.contains("://")
    tidy = F.coalesce(_tidy(F.when(F.is_valid_utf8(text) & ~noise, text)), _without_any_noise(text))
    return let(tidy, lambda kept: F.when(F.length(kept) > 0, _upper_first(kept)))


def clean_or_raw(text: Column) -> Column:
    return F.coalesce(clean_for_inference(text), text)


def _finish(text: Column, lowercase: bool, min_len: int) -> Column:
    squeezed = _squeeze(text)
    shown = F.lower(squeezed) if lowercase else squeezed
    return let(shown, lambda kept: F.when(F.length(kept) >= max(min_len, 1), kept))


def clean_for_training(text: Column, lowercase: bool = True, min_len: int = 2) -> Column:
    """Heavier cleaning that keeps doubled ``!`` and ``?`` as a signal."""
    bare = _without_noise(normalise(text), URL, MEDIA_ID_SEPARATED)
    bare = F.regexp_replace(bare, CONTROL_AND_INVISIBLE, " ")
    bare = F.regexp_replace(bare, STRETCHED_LETTERS, "$1$1")
    bare = F.regexp_replace(bare, STRETCHED_EMPHASIS, "$1$1")
    bare = F.regexp_replace(bare, STRETCHED_PUNCTUATION, "$1")
    return _finish(bare, lowercase, min_len)


def clean_strict(text: Column, lowercase: bool = True, min_len: int = 2) -> Column:
    """As for training, without emoji and with every punctuation run cut to one."""
    bare = _without_noise(normalise(text), URL, MEDIA_ID_SEPARATED)
    bare = F.regexp_replace(F.regexp_replace(bare, CONTROL_AND_INVISIBLE, " "), EMOJI, " ")
    bare = F.regexp_replace(bare, STRETCHED_LETTERS, "$1$1")
    bare = F.regexp_replace(bare, STRETCHED_ANY, "$1")
    return _finish(bare, lowercase, min_len)


def has_emoji(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(EMOJI)
