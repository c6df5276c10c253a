"""Class predictions: a trained Spark ML model or a model the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from feedback_spark.functions import labels, text

# The three classes, in the order of their numbers.
CLASSES = ["positive", "neutral", "negative"]


def predictions(raw: DataFrame, key: str = "row_index") -> DataFrame:
    """(key, polarity, polarity_confidence) from raw (key, sentiment, probabilities).

    ``probabilities`` maps class to a number, or to text that may not be one. A
    class or a probability may come as a list, of which the first value counts.
    """
    sentiment, probabilities = raw.schema["sentiment"].dataType, raw.schema["probabilities"].dataType
    if isinstance(sentiment, T.ArrayType):
        raw = raw.withColumn("sentiment", labels.first_of(F.col("sentiment")))
    if isinstance(probabilities.valueType, T.ArrayType):
        raw = raw.withColumn("probabilities", F.transform_values("probabilities", lambda _, v: labels.first_of(v)))
    confidence = labels.predicted_confidence(F.col("sentiment"), F.col("probabilities"))
    return raw.select(
        key,
        labels.five_level(F.col("sentiment"), confidence).alias("polarity"),
        labels.rounded_confidence(F.col("sentiment"), F.col("probabilities")).alias("polarity_confidence"),
    )


def _features(texts: DataFrame, text_column: str) -> DataFrame:
    return texts.withColumn("terms", text.words(text.clean_text(F.coalesce(F.col(text_column), F.lit("")))))


def train_classifier(
    labelled: DataFrame, text_column: str, label_column: str, *, features: int = 1 << 16, iterations: int = 20
) -> PipelineModel:
    """Logistic regression over hashed word counts, from rows labelled pos, neutral or neg.

    Hashing needs no vocabulary, so nothing grows with the data but the passes
    over it; repeated passes read the cached vectors.
    """
    number = (
        F.when(F.col(label_column) == "pos", 0.0)
        .when(F.col(label_column) == "neutral", 1.0)
        .when(F.col(label_column) == "neg", 2.0)
    )
    rows = _features(labelled, text_column).withColumn("class", number).filter("class IS NOT NULL")
    stages = [
        HashingTF(inputCol="terms", outputCol="features", numFeatures=features),
        LogisticRegression(
            featuresCol="features", labelCol="class", maxIter=iterations, regParam=0.01, family="multinomial"
        ),
    ]
    return Pipeline(stages=stages).fit(rows.select("terms", "class"))


def score_texts(texts: DataFrame, model: PipelineModel, text_column: str, key: str = "row_index") -> DataFrame:
    """(key, sentiment, probabilities) for every text; a map-side projection."""
    p = vector_to_array("probability")
    names = F.array(*[F.lit(c) for c in CLASSES])
    pairs = F.map_from_arrays(F.slice(names, F.lit(1), F.size(p)), p)
    scored = model.transform(_features(texts, text_column).select(key, "terms"))
    return scored.select(
        key, F.get(names, F.col("prediction").cast("int")).alias("sentiment"), pairs.alias("probabilities")
    )


def score_with(
    texts: DataFrame,
    predict: Callable[[pd.Series], pd.DataFrame],
    text_column: str,
    key: str = "row_index",
) -> DataFrame:
    """Scores by the caller's own model, one Arrow batch of a partition at a time.

    ``predict`` takes texts and returns the columns ``sentiment`` and
    ``probabilities`` (a dict per row), one row per text in order.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = predict(batch[text_column])
            if len(out) != len(batch):
                raise ValueError(f"{len(out)} predictions for {len(batch)} texts")
            yield pd.DataFrame({
                key: batch[key].to_numpy(),
                "sentiment": out["sentiment"].to_numpy(),
                "probabilities": [
                    {k: str(v[0] if isinstance(v, list) and v else v) for k, v in p.items()}
                    for p in out["probabilities"]
                ],
            })

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, text_column).mapInPandas(
        run, f"{key} {kind}, sentiment string, probabilities map<string,string>"
    )
