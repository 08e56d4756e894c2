"""Sentence arrays: splitting, trimming long plots, opinion scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opinara.functions.binding import let
from opinara.functions.cleaning import SPACE

# Words that signal an opinion, and first-person pronouns.
OPINION_WORDS = (
    "love", "loved", "hate", "hated", "great", "terrible", "amazing",
    "awful", "best", "worst", "boring", "brilliant", "disappointing",
    "disappointed", "excellent", "awesome", "horrible", "fantastic",
    "recommend", "waste", "enjoyed", "enjoy", "liked", "disliked",
    "perfect", "garbage", "masterpiece", "overrated", "underrated",
)
FIRST_PERSON = ("i", "my", "me", "we", "our")

# Weights of the score and the length that is penalised.
OPINION_WEIGHT = 2.0
FIRST_PERSON_WEIGHT = 1.0
EXCLAMATION_WEIGHT = 1.5
LONG_PENALTY = 1.0
LONG_SENTENCE = 30


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def sentences(text: Column) -> Column:
    """Pieces after ``.``, ``!`` or ``?`` followed by space; an empty array for blank text."""
    pieces = F.transform(F.split(_strip(F.coalesce(text, F.lit(""))), rf"(?U)(?<=[.!?]){SPACE}+"), _strip)
    return F.filter(pieces, lambda piece: piece != "")


def last_sentences(text: Column, n: int = 3, min_sentences: int = 6) -> Column:
    return let(
        sentences(text),
        lambda parts: F.when(F.size(parts) >= min_sentences, F.array_join(F.slice(parts, -n, n), " ")).otherwise(text),
    )


def opinion_score(sentence: Column) -> Column:
    """Weighted hits per word, so that length alone does not win."""
    exclamations = F.length(sentence) - F.length(F.replace(sentence, F.lit("!"), F.lit("")))

    def weight(word: Column) -> Column:
        opinion = F.when(word.isin(*OPINION_WORDS), OPINION_WEIGHT)
        return opinion.when(word.isin(*FIRST_PERSON), FIRST_PERSON_WEIGHT).otherwise(0.0)

    def per_word(words: Column) -> Column:
        hits = F.aggregate(words, F.lit(0.0), lambda total, word: total + weight(word))
        penalty = F.when(F.size(words) > LONG_SENTENCE, LONG_PENALTY).otherwise(0.0)
        score = (hits + exclamations * EXCLAMATION_WEIGHT - penalty) / F.size(words)
        return F.when(F.size(words) == 0, 0.0).otherwise(score)

    return let(F.regexp_extract_all(F.lower(sentence), F.lit("([a-z']+)"), F.lit(1)), per_word)


def top_opinions(text: Column, k: int = 3, min_sentences: int = 6) -> Column:
    """The k best sentences in their own order; every repeat of a chosen sentence stays."""

    def scored(parts: Column) -> Column:
        return F.transform(
            parts,
            lambda piece, i: F.struct(opinion_score(piece).alias("score"), (-i).alias("position"), piece.alias("piece")),
        )

    def chosen(parts: Column) -> Column:
        best = F.slice(F.sort_array(scored(parts), asc=False), 1, k)["piece"]
        kept = let(best, lambda names: F.filter(parts, lambda piece: F.array_contains(names, piece)))
        return F.when(F.size(parts) >= min_sentences, F.array_join(kept, " ")).otherwise(text)

    return let(sentences(text), chosen)
