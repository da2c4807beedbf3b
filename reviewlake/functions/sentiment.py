"""Rule-based sentiment as columns.

Every scorer yields a struct ``(score, label, confidence, is_ambiguous, model)`` so that scorers can replace one
another inside one ``when`` ladder.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from reviewlake.functions import scans, text as T
from reviewlake.functions.numeric import rnd
from reviewlake.functions.vocabulary import DEFAULT_LEXICON, HEURISTIC_WORDS, Lexicon

POSITIVE, NEUTRAL, NEGATIVE = "positive", "neutral", "negative"
LABELS = (POSITIVE, NEUTRAL, NEGATIVE)

# The two label -> number maps and the cuts of each scorer.
GOLD_SCORES = {POSITIVE: 0.8, NEUTRAL: 0.0, NEGATIVE: -0.8}
UNIT_SCORES = {POSITIVE: 1, NEUTRAL: 0, NEGATIVE: -1}
TEXT_CUT = 0.05
COMBINED_CUT = 0.3
COMBINED_SOFT_CUT = 0.2


def label_by_cut(score: Column, cut: float) -> Column:
    """Three-way label with inclusive cuts at +cut and -cut; a null score has no label."""
    return (
        F.when(score >= cut, POSITIVE).when(score <= -cut, NEGATIVE).when(score.isNotNull(), NEUTRAL)
    )


def label_value(label: Column, values: dict[str, float]) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(label == name, F.lit(value)).otherwise(out)
    return out


def stars_label(stars: Column) -> Column:
    return F.when(stars >= 4, POSITIVE).when(stars <= 2, NEGATIVE).when(stars.isNotNull(), NEUTRAL)


def _result(score: Column, label: Column, confidence: Column, ambiguous: Column, model: Column | str) -> Column:
    return F.struct(
        score.cast("double").alias("score"),
        label.alias("label"),
        confidence.cast("double").alias("confidence"),
        ambiguous.alias("is_ambiguous"),
        (F.lit(model) if isinstance(model, str) else model).alias("model"),
    )


def baseline(stars: Column) -> Column:
    """Stars alone: 1..5 -> -1, -0.5, 0, 0.5, 1."""
    score = (stars.cast("double") - 3.0) / 2.0
    return _result(score, stars_label(stars), F.lit(1.0), stars == 3, "baseline_stars_v1")


def polar_words(text: Column, lexicon: Lexicon = DEFAULT_LEXICON, batched: bool = False) -> Column:
    """The words of a text that carry polarity, in order. One hash probe per word.

    ``batched`` finds them with ``scans.find``; only what that leaves out is split into words.
    """
    split = F.filter(T.ml_words(text), lambda w: w.isin(lexicon.words))
    if not batched:
        return split
    marked = lambda scan: F.transform(scan["marks"], lambda m: m["word"])
    return T.let(scans.find(text, lexicon.words), lambda scan: F.when(scan.isNull(), split).otherwise(marked(scan)))


def polar_counts(polar: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> tuple[Column, Column]:
    """Positive and negative hits; a word listed on both sides counts as positive."""
    pos = F.size(F.filter(polar, lambda w: w.isin(sorted(lexicon.positive))))
    return pos, F.size(polar) - pos


def lexicon_score(pos: Column, neg: Column) -> Column:
    """(pos - neg) / (pos + neg), 4 digits, 0 without hits; label cut at 0.05."""
    score = F.coalesce(rnd(F.try_divide(pos - neg, pos + neg), 4), F.lit(0.0))
    label = label_by_cut(score, TEXT_CUT)
    return _result(score, label, F.abs(score), label == NEUTRAL, "lexicon_polarity_v1")


def lexicon_sentiment(text: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Polarity of a text by counting lexicon words."""
    pos, neg = polar_counts(polar_words(text, lexicon), lexicon)
    return lexicon_score(pos, neg)


def _hits(lowered: Column, words: Iterable[str]) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + lowered.contains(word).cast("int")
    return total


def heuristic(text: Column, language: Column) -> Column:
    """Keyword substrings by language, for languages without a text scorer."""
    lowered = F.lower(F.coalesce(text, F.lit("")))

    def by_language(side: str) -> Column:
        return (
            F.when(language == "es", _hits(lowered, HEURISTIC_WORDS["es"][side]))
            .when(language == "pt", _hits(lowered, HEURISTIC_WORDS["pt"][side]))
            .otherwise(_hits(lowered, HEURISTIC_WORDS["other"][side]))
        )

    pos, neg = by_language(POSITIVE), by_language(NEGATIVE)
    score = (
        F.when(pos > neg, F.least(F.lit(0.5) + pos * 0.1, F.lit(1.0)))
        .when(neg > pos, F.greatest(F.lit(-0.5) - neg * 0.1, F.lit(-1.0)))
        .otherwise(F.lit(0.0))
    )
    label = F.when(pos > neg, POSITIVE).when(neg > pos, NEGATIVE).otherwise(NEUTRAL)
    confidence = rnd(F.abs(pos - neg) / F.greatest(pos + neg, F.lit(1)), 4)
    model = F.concat(F.lit("heuristic_"), language, F.lit("_v1"))
    return _result(rnd(score, 4), label, confidence, pos == neg, model)


def combined(by_text: Column, by_stars: Column, weight_text: float = 0.6, variant: str = "cut") -> Column:
    """Weighted mix of a text struct and a stars struct.

    ``cut``: labels at +-0.3, ambiguous when neutral or when text and stars contradict each other.
    ``soft``: labels at +-0.05, ambiguous when weak or when the two labels differ at all.
    """
    mixed = by_text["score"] * weight_text + by_stars["score"] * (1 - weight_text)
    differ = by_text["label"] != by_stars["label"]
    confidence = rnd(F.least(by_text["confidence"], by_stars["confidence"]), 4)
    if variant == "cut":
        label = label_by_cut(mixed, COMBINED_CUT)
        contradict = differ & (by_text["label"] != NEUTRAL) & (by_stars["label"] != NEUTRAL)
        return _result(rnd(mixed, 4), label, confidence, (label == NEUTRAL) | contradict, "combined_v1")
    if variant == "soft":
        label = label_by_cut(mixed, TEXT_CUT)
        return _result(rnd(mixed, 4), label, confidence, (F.abs(mixed) < COMBINED_SOFT_CUT) | differ, "combined_v2")
    raise ValueError(f"unknown combined variant {variant!r}: use 'cut' or 'soft'")
