"""The classifier: assembling, fitting, tuning, predicting, keeping, and the daily job.

Fitted trees have no SQL form. What is known of them without fitting has: the assembled rows, the
keys and labels that are scored, that probabilities add up and the prediction is their greatest,
that a loaded model says the same, the newest rows. Values of scores are left to the tests.
"""

from pyspark.sql import functions as F

from tidemark.operators.bars import technical_features
from tidemark.operators.labels import classification_report
from tidemark.plans import daily
from tidemark.plans import training as M
from tidemark.session import fresh_path, materialise

from .q_exogenous import dataset
from .q_labels import CASE
from .registry import query
from .sqlviews import exact, rounded as sql, view
from .views import rounded

SMALL = M.Params(max_depth=3, n_estimators=3)
FOREST = M.Params(max_depth=4, n_estimators=10, boosted=False)
# the whole space but for its size: every parameter takes part
NARROW = M.SEARCH | {"max_depth": (2, 3), "n_estimators": (2, 3), "min_gain": (0.0, 0.01)}
CANDIDATES = M.search_table(2, NARROW)
FEATURES = ("returns", "log_returns", "volatility_6h", "volatility_24h", "volatility_72h", "rsi_14", "atr_14")

view("complete_bars", "SELECT * FROM technical WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in FEATURES))

view("complete_forward", """
SELECT *, lead(close, 3) OVER w / nullif(close, 0) - 1 AS forward_return,
       CASE WHEN count(again) OVER a = 3 AND row_number() OVER w >= 3 THEN stddev_samp(again) OVER a END AS forward_volatility,
       (lead(high, 3) OVER w - lead(low, 3) OVER w) / nullif(close, 0) AS forward_hl_range
FROM (SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts), 0) - 1 AS again FROM complete_bars)
WINDOW w AS (PARTITION BY symbol ORDER BY ts), a AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)
""")

view("training_rows", f"""
SELECT *, CASE WHEN age <= 7 THEN 1.0 ELSE greatest(exp(-0.001 * age), 0.1) END AS weight,
       dense_rank() OVER (ORDER BY ts) <= floor(0.8 * (SELECT count(DISTINCT ts) FROM complete_forward WHERE forward_return IS NOT NULL)) AS is_train
FROM (SELECT *, CAST({CASE} AS INT) AS regime, (epoch_us(max(ts) OVER (PARTITION BY symbol)) - epoch_us(ts)) / 86400e6 AS age
      FROM complete_forward WHERE forward_return IS NOT NULL)
""")


def training_rows(v):
    """Labelled, weighted feature rows, computed once per query."""
    return materialise(daily.training_set(technical_features(v.bars).na.drop("any")), "rows")


def fitted_on(rows, p=SMALL):
    return M.ml_train(rows.filter("is_train"), daily.feature_columns(rows), p)


@query("ml_assemble", sql("symbol, ts, label", "weight " + " ".join(FEATURES), """
SELECT *, CAST(regime AS DOUBLE) AS label FROM training_rows"""))
def ml_assemble(v):
    """Every element of the feature vector, next to label and weight."""
    rows = training_rows(v)
    names = daily.feature_columns(rows)
    out = M.ml_assemble(rows, names, weight="weight").withColumn("x", M.vector_to_array("features"))
    return rounded(out.select("symbol", "ts", "label", "weight", *[F.col("x")[i].alias(n) for i, n in enumerate(names)]))


def _report(name, params, part):
    @query(name, exact(f"""
SELECT CAST(regime AS VARCHAR) AS name, count(*) AS support, TRUE AS in_range FROM training_rows WHERE {part} GROUP BY 1
UNION ALL SELECT unnest(['accuracy', 'macro avg', 'weighted avg']), (SELECT count(*) FROM training_rows WHERE {part}), TRUE"""))
    def run(v):
        """Report of the fitted model on the rows it was fitted on: all classes with their support."""
        rows = training_rows(v)
        report = classification_report(M.ml_predict(fitted_on(rows, params), rows.filter(part)))
        inside = [F.col(c).between(0, 1) for c in ("precision", "recall", "f1")]
        return report.select("name", "support", (inside[0] & inside[1] & inside[2]).alias("in_range"))


_report("ml_train", FOREST, "is_train")
_report("ml_train_boosted", SMALL, "is_train")


@query("ml_predict", exact("SELECT symbol, ts, regime, TRUE AS is_class FROM training_rows WHERE NOT is_train"))
def ml_predict(v):
    rows = training_rows(v)
    out = M.ml_predict(fitted_on(rows), rows.filter("NOT is_train"))
    return out.select("symbol", "ts", "regime", F.col("prediction").between(0, M.CLASSES - 1).alias("is_class"))


def _proba(name, params):
    @query(name, sql("symbol, ts, is_best", "total", """
SELECT symbol, ts, TRUE AS is_best, 1.0 AS total FROM training_rows WHERE NOT is_train"""))
    def run(v):
        """Probabilities of all classes add up to 1, and the predicted class has the greatest."""
        rows = training_rows(v)
        out = M.ml_proba(fitted_on(rows, params), rows.filter("NOT is_train"))
        each = F.array(*[f"p_{c}" for c in range(M.CLASSES)])
        total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        return rounded(out.select("symbol", "ts", (F.get(each, F.col("prediction")) == F.array_max(each)).alias("is_best"), total.alias("total")))


_proba("ml_proba", SMALL)
_proba("ml_proba_forest", FOREST)


@query("feature_importance", sql("feature", "total", f"SELECT unnest({list(FEATURES)}) AS feature, 1.0 AS total"))
def feature_importance(v):
    """Every feature has an importance, and all of them add up to 1."""
    table = M.feature_importance(v.spark, fitted_on(training_rows(v)))
    return rounded(table.select("feature", table.agg(F.sum("importance")).scalar().alias("total")))


@query("top_features")
def top_features(v):
    return rounded(M.top_features(M.feature_importance(v.spark, fitted_on(training_rows(v)))))


@query("ml_tune")
def ml_tune(v):
    """Random candidates from the search space, scored over folds at common times."""
    rows = training_rows(v)
    return rounded(M.ml_tune(rows.filter("is_train"), daily.feature_columns(rows), CANDIDATES))


@query("ml_persist", exact("SELECT symbol, ts, TRUE AS same FROM training_rows"))
def ml_persist(v):
    """A model that was saved and loaded again predicts and weighs every row as before."""
    rows = training_rows(v)
    path = fresh_path(v.spark, "model")
    fitted = fitted_on(rows)
    M.ml_save(v.spark, fitted, path)
    values = ("prediction", *[f"p_{c}" for c in range(M.CLASSES)])
    before, after = (M.ml_proba(m, rows).select("symbol", "ts", F.struct(*values).alias(n)) for m, n in ((fitted, "was"), (M.ml_load(v.spark, path), "now")))
    return before.join(after, ["symbol", "ts"]).select("symbol", "ts", (F.col("was") == F.col("now")).alias("same"))


@query("ml_retrain_daily")
def ml_retrain_daily(v):
    rows = training_rows(v)
    fitted, _ = M.ml_retrain_daily(rows, daily.feature_columns(rows), fresh_path(v.spark, "models"), CANDIDATES)
    return rounded(M.feature_importance(v.spark, fitted))


@query("latest_signal", sql("symbol, ts", "price volatility_24h total", """
SELECT symbol, ts, close AS price, volatility_24h, 1.0 AS total FROM complete_bars
QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1"""))
def latest_signal(v):
    """The newest row of each symbol, price and probabilities included."""
    rows = training_rows(v)
    out = daily.latest_signal(technical_features(v.bars).na.drop("any"), fitted_on(rows))
    total = sum((F.col(f"p_{c}") for c in range(1, M.CLASSES)), F.col("p_0"))
    return rounded(out.select("symbol", "ts", "price", "volatility_24h", total.alias("total")))


@query("daily_pipeline")
def daily_pipeline(v):
    """All stages over all sources; the result is the table of price levels."""
    return rounded(daily.run(dataset(v), fresh_path(v.spark, "daily"), CANDIDATES).levels.select(
        "symbol", "ts", "level", "price", "side", "quantity", "value_usd", F.col("bad_price")))
