"""Word lists: polarity, word weights, emotions, shifters, stop words.

The shipped lists are small seeds written for this package. ``load_lexicon``
reads a list of any size in the same shape. No join below is told to
broadcast: an inline list or a small file has a known size, so Spark
broadcasts it under ``spark.sql.autoBroadcastJoinThreshold``, and a list above
that limit is joined by a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession, functions as F

# Seed list of polarity words.
POSITIVE_WORDS = (
    "amazing appreciate awesome beautiful best better captivating clear clearly comfortable "
    "creative delight easy effective efficient engaging enjoy enjoyed excellent exceptional "
    "fair fantastic fast favorite fine flexible fresh friendly fun generous glad good great "
    "happy helpful impressive improved incredible informative inspiring interesting kind love "
    "loved nice outstanding patient perfect pleasant positive practical recommend reliable "
    "rewarding satisfied smooth strong superb support supportive terrific thorough useful "
    "valuable well wonderful worth"
)
NEGATIVE_WORDS = (
    "annoying awful bad bland boring broken bug bugs complain complaint complicated confused "
    "confusing crash dated delay delayed difficult dirty disappointed disappointing disorganized "
    "dull error expensive fail failed failure frustrated frustrating hard hate horrible "
    "inadequate incomplete irrelevant issue issues lack lacking late loud messy missing "
    "negative noisy outdated overwhelming poor poorly problem problems rude rushed sad slow "
    "stress stressful terrible tired unclear unfair unhelpful unorganized unreliable "
    "unresponsive useless waste weak worse worst wrong"
)
STRONG_WORDS = (
    "amazing awesome awful excellent exceptional fantastic hate horrible incredible "
    "outstanding perfect superb terrible terrific useless wonderful worst"
)

# Seed list of emotion words, one line per emotion.
EMOTION_WORDS = {
    "joy": "amazing beautiful delight enjoy enjoyed excellent fun glad happy love loved wonderful",
    "sadness": "disappointed disappointing lost miss sad sorry tired unhappy failure",
    "anger": "annoying complain frustrated frustrating hate rude unfair wrong",
    "fear": "afraid anxious danger overwhelming panic risk stress stressful worry",
    "surprise": "amazing incredible sudden suddenly surprise surprised unexpected",
    "disgust": "awful dirty gross horrible nasty rude terrible",
    "trust": "clear fair friendly helpful reliable recommend support supportive",
    "anticipation": "expect hope hoped plan ready soon wait",
    "positive": "best better excellent good great helpful nice useful",
    "negative": "awful bad horrible poor terrible useless worse worst",
}


@dataclass(frozen=True)
class Shifters:
    """Words that turn or scale the weight of a neighbouring word.

    They are closed classes of function words, so they travel as literal sets
    inside the expression.
    """

    negators: tuple[str, ...]
    amplifiers: tuple[str, ...]
    softeners: tuple[str, ...]


# Seed shifters. Cleaning cuts "don't" into "don t", hence the stubs.
SEED_SHIFTERS = Shifters(
    negators=tuple("not no never none cannot nobody neither nor without hardly don doesn didn isn "
                   "wasn aren weren won wouldn shouldn couldn".split()),
    amplifiers=tuple("very really extremely absolutely totally completely highly so too most "
                     "truly especially".split()),
    softeners=tuple("slightly somewhat barely fairly rather little kind sort almost partly "
                    "bit".split()),
)


def inline_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A literal relation, whose exact size the optimizer knows."""

    def text(cell: object) -> str:
        if isinstance(cell, str):
            return "'" + cell.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{cell}D" if isinstance(cell, float) else str(cell)

    values = ", ".join("(" + ", ".join(text(c) for c in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def seed_polarity(spark: SparkSession) -> DataFrame:
    """(word, sentiment) with sentiment positive or negative."""
    rows = [(w, "positive") for w in POSITIVE_WORDS.split()]
    rows += [(w, "negative") for w in NEGATIVE_WORDS.split()]
    return inline_table(spark, "word, sentiment", rows)


def seed_weights(spark: SparkSession) -> DataFrame:
    """(word, weight) with weight from -1 to 1."""
    strong = set(STRONG_WORDS.split())
    rows = [(w, 1.0 if w in strong else 0.5) for w in POSITIVE_WORDS.split()]
    rows += [(w, -1.0 if w in strong else -0.5) for w in NEGATIVE_WORDS.split()]
    return inline_table(spark, "word, weight", rows)


def seed_emotions(spark: SparkSession) -> DataFrame:
    """(word, sentiment), several rows for a word of several emotions."""
    rows = [(w, emotion) for emotion, listed in EMOTION_WORDS.items() for w in listed.split()]
    return inline_table(spark, "word, sentiment", rows)


def stop_words(spark: SparkSession) -> DataFrame:
    """(word) from Spark ML's English list."""
    listed = StopWordsRemover.loadDefaultStopWords("english")
    # Cleaning cuts at the apostrophe, so the parts of "don't" are stop words too.
    parts = sorted({part for w in listed for part in w.lower().split("'")})
    return inline_table(spark, "word", [(w,) for w in parts if w])


def load_lexicon(spark: SparkSession, path: str, columns: str = "word string, sentiment string") -> DataFrame:
    """A word list from Parquet or headed CSV files, words in lower case, each row once."""
    if path.rstrip("/").endswith(".csv"):
        df = spark.read.schema(columns).option("header", True).option("enforceSchema", False).csv(path)
    else:
        df = spark.read.schema(columns).parquet(path)
    return df.withColumn("word", F.lower(F.trim("word"))).filter("word <> ''").distinct()


def lexicon_profile(lexicon: DataFrame) -> DataFrame:
    """Words per class of a lexicon."""
    return lexicon.groupBy("sentiment").agg(F.countDistinct("word").alias("words"))


@dataclass(frozen=True)
class Lexicons:
    """The lists one analysis uses."""

    polarity: DataFrame
    weights: DataFrame
    emotions: DataFrame
    stops: DataFrame
    shifters: Shifters = SEED_SHIFTERS
    # Words left out of topics; the list for frequent words serves when there is none.
    topic_stops: DataFrame | None = None

    @classmethod
    def seed(cls, spark: SparkSession) -> "Lexicons":
        return cls(seed_polarity(spark), seed_weights(spark), seed_emotions(spark), stop_words(spark))
