"""Training and using the regime classifier with Spark ML."""

from __future__ import annotations

import json
import random
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.labels import balanced_weight, ts_cv_folds, weighted_f1
from ..session import materialise
from .boosting import BoostedModel, fit_boosted

SEED = 42
CLASSES = 4
TRIALS, QUICK_TRIALS, FOLDS = 50, 20, 3

# The ranges searched, per hyper-parameter (low, high).
SEARCH = {
    "max_depth": (3, 12),
    "learning_rate": (0.005, 0.3),
    "n_estimators": (100, 800),
    "min_child_weight": (1, 20),
    "subsample": (0.5, 1.0),
    "colsample": (0.5, 1.0),
    "min_gain": (0.0, 10.0),
}
LOG_SCALE = ("learning_rate",)
BOOSTED_ONLY = ("learning_rate",)  # a forest has no such parameter


@dataclass(frozen=True)
class Params:
    """Hyper-parameters of boosted trees, or of a forest (which ignores ``learning_rate``)."""

    max_depth: int = 5
    n_estimators: int = 100
    min_child_weight: int = 1
    subsample: float = 1.0
    colsample: float = 0.5
    min_gain: float = 0.0
    learning_rate: float = 0.1
    boosted: bool = True


@dataclass(frozen=True)
class Fitted:
    """A model on assembled features; forests and boosted trees give the same columns."""

    model: RandomForestClassificationModel | BoostedModel
    params: Params
    features: tuple[str, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(assembler(self.features).transform(df))


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")


def ml_assemble(df: DataFrame, features: Sequence[str], label: str = "regime",
                weight: str = "final_weight") -> DataFrame:
    """Feature vector, label and weight next to the key columns."""
    kept = [c for c in ("symbol", "ts", "fold", "role") if c in df.columns]
    named = df.withColumn("label", F.col(label).cast("double")).withColumn("weight_", F.col(weight))
    return assembler(features).transform(named).select(*kept, "features", "label", F.col("weight_").alias("weight"))


def fit_assembled(rows: DataFrame, p: Params) -> RandomForestClassificationModel | BoostedModel:
    """Trees on rows from ``ml_assemble``, which are read many times and should be written out."""
    tree = dict(maxDepth=p.max_depth, minInstancesPerNode=p.min_child_weight, minInfoGain=p.min_gain,
                subsamplingRate=p.subsample, featureSubsetStrategy=str(p.colsample), seed=SEED,
                featuresCol="features", labelCol="label", weightCol="weight")
    if p.boosted:
        return fit_boosted(rows, GBTClassifier(maxIter=p.n_estimators, stepSize=p.learning_rate, **tree), CLASSES)
    return RandomForestClassifier(numTrees=p.n_estimators, **tree).fit(rows)


def ml_train(df: DataFrame, features: Sequence[str], p: Params = Params(), label: str = "regime",
             weight: str = "weight") -> Fitted:
    """Fit on all rows, weighted by age and class.

    Tree fitting passes over its input many times, so the assembled rows are written out first.
    """
    rows = balanced_weight(df.withColumn("weight", F.col(weight)), label)
    return Fitted(fit_assembled(materialise(ml_assemble(rows, features, label), "training"), p), p, tuple(features))


def ml_predict(fitted: Fitted, df: DataFrame) -> DataFrame:
    return fitted.transform(df).withColumn("prediction", F.col("prediction").cast("int")).drop(
        "features", "rawPrediction", "probability")


def ml_proba(fitted: Fitted, df: DataFrame) -> DataFrame:
    """Predictions with one probability column per class."""
    scored = fitted.transform(df).withColumn("_p", vector_to_array("probability"))
    return (
        scored.withColumn("prediction", F.col("prediction").cast("int"))
        .withColumns({f"p_{c}": F.coalesce(F.get("_p", F.lit(c)), F.lit(0.0)) for c in range(CLASSES)})
        .drop("features", "rawPrediction", "probability", "_p")
    )


def feature_importance(spark: SparkSession, fitted: Fitted) -> DataFrame:
    """Features by importance; as many rows as there are features."""
    model = fitted.model
    values = model.importances() if isinstance(model, BoostedModel) else [float(x) for x in model.featureImportances.toArray()]
    rows = list(zip(fitted.features, values, strict=True))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature")


def top_features(importance: DataFrame, n: int = 5) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)


def search_table(trials: int, search: dict = SEARCH, seed: int = SEED, boosted: bool = True) -> list[Params]:
    """Seeded random points of the search space, over the parameters the kind of trees has."""
    draw = random.Random(seed)
    names = [n for n in search if boosted or n not in BOOSTED_ONLY]

    def point(name: str):
        low, high = search[name]
        if isinstance(low, int):
            return draw.randint(low, high)
        if name in LOG_SCALE:
            return low * (high / low) ** draw.random()
        return draw.uniform(low, high)

    return [Params(**{name: point(name) for name in names}, boosted=boosted) for _ in range(trials)]


def ml_tune(df: DataFrame, features: Sequence[str], candidates: Sequence[Params], k: int = FOLDS,
            label: str = "regime", parallelism: int = 4) -> DataFrame:
    """Mean weighted F1 of each candidate over time-ordered folds, best first.

    Class weights come from the whole training set, once. The assembled folds are written to
    the shared folder and read by all fits, which run side by side.
    """
    spark = df.sparkSession
    weighted = balanced_weight(df, label).select("symbol", "ts", label, "final_weight", *features)
    folds = materialise(ml_assemble(ts_cv_folds(weighted, k), features, label), "folds")

    def score(job: tuple[int, int]) -> tuple[int, int, float]:
        trial, fold = job
        part = folds.filter(F.col("fold") == fold)
        model = fit_assembled(part.filter("role = 'train'"), candidates[trial])
        guessed = model.transform(part.filter("role = 'test'"))
        return trial, fold, float(weighted_f1(guessed, "label").first()[0] or 0.0)

    jobs = [(t, f) for t in range(len(candidates)) for f in range(k)]
    with ThreadPool(parallelism) as pool:
        scores = pool.map(score, jobs)
    rows = [(t, f, s, json.dumps(vars(candidates[t]))) for t, f, s in scores]
    per_fold = spark.createDataFrame(rows, "trial int, fold int, f1 double, params string")
    return per_fold.groupBy("trial", "params").agg(F.avg("f1").alias("mean_f1")).orderBy(
        F.desc("mean_f1"), "trial")


def best_of(tuned: DataFrame) -> Params:
    return Params(**json.loads(tuned.first()["params"]))


def ml_save(spark: SparkSession, fitted: Fitted, path: str) -> None:
    """Model plus a one-row table with its parameters and features."""
    if isinstance(fitted.model, BoostedModel):
        fitted.model.save(f"{path}/model")
    else:
        fitted.model.write().overwrite().save(f"{path}/model")
    notes = [(json.dumps(vars(fitted.params)), list(fitted.features), CLASSES)]
    spark.createDataFrame(notes, "params string, features array<string>, n_classes int") \
        .write.mode("overwrite").parquet(f"{path}/metadata")


def ml_load(spark: SparkSession, path: str) -> Fitted:
    notes = spark.read.parquet(f"{path}/metadata").first()
    p = Params(**json.loads(notes["params"]))
    model = BoostedModel.load(spark, f"{path}/model") if p.boosted else RandomForestClassificationModel.load(f"{path}/model")
    return Fitted(model, p, tuple(notes["features"]))


def ml_retrain_daily(df: DataFrame, features: Sequence[str], root: str, candidates: Sequence[Params] | None = None,
                     label: str = "regime") -> tuple[Fitted, str]:
    """Tune quickly (20 random points by default), fit on everything, save under a name with the time of day."""
    spark = df.sparkSession
    tuned = ml_tune(df, features, candidates or search_table(QUICK_TRIALS), label=label)
    fitted = ml_train(df, features, best_of(tuned), label)
    path = f"{root}/model_retrain_{datetime.now(timezone.utc):%Y%m%d_%H%M%S_%f}"
    ml_save(spark, fitted, path)
    return fitted, path
