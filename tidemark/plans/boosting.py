"""Boosted trees for several classes: one against the rest, with probabilities and importances.

Spark's boosted trees know two classes. Each class gets a model of its own against all others; the
margins of all become one probability vector, each margin through the logistic curve the trees were
fitted with, then scaled to a sum of 1. Everything after the trees is column expressions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BoostedModel:
    """``models``: per class label its model; classes never seen in training have none and probability 0."""

    models: dict[int, GBTClassificationModel]
    n_classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` (a vector over all classes) and ``prediction`` (the first class of the greatest)."""
        out, raw = df, {c: f"_raw_{c}" for c in self.models}
        for c, model in self.models.items():
            out = model.transform(out, {model.rawPredictionCol: raw[c], model.probabilityCol: "", model.predictionCol: ""})

        def share(c: int) -> Column:
            if c not in raw:
                return F.lit(0.0)
            return 1 / (1 + F.exp(F.lit(-2.0) * vector_to_array(raw[c])[1]))

        each = F.array(*[share(c) for c in range(self.n_classes)])
        out = out.withColumn("_each", each).drop(*raw.values())
        total = F.aggregate("_each", F.lit(0.0), lambda a, x: a + x)
        # margins so low that every share is 0 leave no preference
        scaled = F.transform("_each", lambda x: F.when(total > 0, x / total).otherwise(F.lit(1.0 / self.n_classes)))
        out = out.withColumn("_each", scaled)
        best = F.array_position("_each", F.array_max("_each")) - 1
        return out.withColumn("probability", array_to_vector("_each")).withColumn("prediction", best.cast("double")).drop("_each")

    def importances(self) -> list[float]:
        """Mean importance of each feature over the classes' models; they add up to 1 where any tree splits."""
        per_class = [m.featureImportances.toArray() for m in self.models.values()]
        used = [x for x in per_class if x.sum() > 0]
        return [float(x) for x in sum(used) / len(used)] if used else [0.0] * (len(per_class[0]) if per_class else 0)

    def save(self, path: str) -> None:
        for c, model in self.models.items():
            model.write().overwrite().save(f"{path}/class_{c}")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(sorted(self.models)), self.n_classes)], "classes string, n_classes int") \
            .write.mode("overwrite").parquet(f"{path}/classes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BoostedModel:
        notes = spark.read.parquet(f"{path}/classes").first()
        return BoostedModel({c: GBTClassificationModel.load(f"{path}/class_{c}") for c in json.loads(notes["classes"])}, notes["n_classes"])


def fit_boosted(rows: DataFrame, trees: GBTClassifier, n_classes: int, label: str = "label", parallelism: int = 4) -> BoostedModel:
    """``trees`` fitted to each class of ``rows`` against the rest, side by side.

    ``rows`` is read many times and should be written out; a class with all rows has nothing to
    be told apart from and is certain.
    """
    found = sorted(int(r[0]) for r in rows.select(label).distinct().collect())  # at most n_classes rows
    target = "_is_class"

    def one(c: int) -> tuple[int, GBTClassificationModel]:
        return c, trees.copy({trees.labelCol: target}).fit(rows.withColumn(target, (F.col(label) == c).cast("double")))

    with ThreadPool(parallelism) as pool:
        return BoostedModel(dict(pool.map(one, found)), n_classes)

