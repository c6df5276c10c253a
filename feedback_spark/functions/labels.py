"""Label, polarity and display mappings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from feedback_spark.functions.numbers import number_or, round_half_even
from feedback_spark.functions.text import strip

# The five levels in order, and what each counts for.
LEVELS = ["Very Positive", "Positive", "Neutral", "Negative", "Very Negative"]
LEVEL_SCORES = [1.0, 0.5, 0.0, -0.5, -1.0]
POSITIVE_LEVELS = ["Very Positive", "Positive"]
NEGATIVE_LEVELS = ["Negative", "Very Negative"]
INTENTS = ["complaint", "suggestion", "inquiry", "compliment", "statement"]

# Limits of the level mappings.
SURE = 0.75
STRONG_SCORE = 0.15
WEAK_SCORE = 0.02


def normalise_label(label: Column, labelled: Column) -> Column:
    """One of pos, neg, neutral, or the lower-cased label itself."""
    known = F.lower(strip(label))
    return (
        F.when(~labelled | label.isNull() | (label == ""), "neutral")
        .when(known.isin("pos", "positive"), "pos")
        .when(known.isin("neg", "negative"), "neg")
        .otherwise(known)
    )


def label_category(label: Column) -> Column:
    return (
        F.when(label == "pos", "Positive")
        .when(label == "neg", "Negative")
        .when(label == "neutral", "Neutral")
        .otherwise("Unknown")
    )


def five_level(sentiment: Column, confidence: Column) -> Column:
    side = strip(F.lower(sentiment))
    sure = confidence >= SURE
    return (
        F.when((side == "positive") & sure, "Very Positive")
        .when(side == "positive", "Positive")
        .when((side == "negative") & sure, "Very Negative")
        .when(side == "negative", "Negative")
        .otherwise("Neutral")
    )


def predicted_confidence(sentiment: Column, probabilities: Column) -> Column:
    """Probability of the predicted class; ``probabilities`` maps class to number or text."""
    side = F.lower(sentiment)
    key = F.when(side.isin("positive", "neutral", "negative"), side).otherwise("neutral")
    return number_or(F.try_element_at(probabilities, key), 0.5)


def rounded_confidence(sentiment: Column, probabilities: Column) -> Column:
    return round_half_even(predicted_confidence(sentiment, probabilities), 4)


def first_of(values: Column) -> Column:
    """First element of a list, null when it is empty."""
    return F.get(values, F.lit(0))


def polarity_class(score: Column) -> Column:
    """Level of a corpus score; the limits themselves belong to the milder level."""
    return (
        F.when(score > STRONG_SCORE, "Very Positive")
        .when(score > WEAK_SCORE, "Positive")
        .when(score < -STRONG_SCORE, "Very Negative")
        .when(score < -WEAK_SCORE, "Negative")
        .otherwise("Neutral")
    )


def level_score(polarity: Column) -> Column:
    chosen = F.lit(0.0)
    for level, score in zip(LEVELS, LEVEL_SCORES):
        chosen = F.when(polarity == level, F.lit(score)).otherwise(chosen)
    return chosen


def level_order(polarity: Column) -> Column:
    """Position among the five levels, from 1; unknown levels come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), polarity)
    return F.when(at > 0, at).otherwise(F.lit(len(LEVELS) + 1).cast("long"))


def polarity_group(polarity: Column) -> Column:
    return (
        F.when(polarity.isin(POSITIVE_LEVELS), "positive")
        .when(polarity.isin(NEGATIVE_LEVELS), "negative")
        .otherwise("neutral")
    )


def badge_group(polarity: Column) -> Column:
    return (
        F.when(polarity.contains("Negative"), "neg")
        .when(polarity.contains("Positive"), "pos")
        .otherwise("neu")
    )


def intent_label(intent: Column) -> Column:
    capital = F.concat(F.upper(F.substring(intent, 1, 1)), F.substr(intent, F.lit(2)))
    return F.when(intent == "statement", "General").otherwise(capital)
