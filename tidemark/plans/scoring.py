"""Scoring texts with a model the caller plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import softmax
from ..operators.exogenous import sentiment_from_probabilities

Scorer = Callable[[list[str]], list[list[float] | None]]


def text_sentiment(df: DataFrame, load: Callable[[], Scorer], text: str = "title") -> DataFrame:
    """Add ``sentiment_score`` and ``confidence`` to every row of ``df``.

    ``load`` runs once per task and returns a function from texts to logits (positive,
    negative, neutral), or None for a text it cannot score. Only the model call runs in
    Python; softmax, score and confidence are column expressions.
    """

    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = load()
        for batch in batches:
            yield pd.Series(score(batch.fillna("").tolist()))

    scored = df.withColumn("_logits", logits(F.col(text))).withColumn("_probs", softmax(F.col("_logits")))
    return sentiment_from_probabilities(scored, "_probs").drop("_logits", "_probs")
