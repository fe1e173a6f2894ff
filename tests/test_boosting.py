"""Boosted trees for several classes: probabilities, importances, keeping, tuning."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from tidemark.plans import training as M

SCHEMA = "symbol string, ts timestamp_ntz, regime int, weight double, x double, y double, noise double"
SMALL = M.Params(max_depth=3, n_estimators=4, colsample=1.0, learning_rate=0.5)


@pytest.fixture(scope="module")
def rows(spark):
    """Four classes by the quadrant of (x, y), one of them rare."""
    from datetime import datetime, timedelta

    draw, out = random.Random(3), []
    for i in range(400):
        x, y = draw.uniform(-1, 1), draw.uniform(-1, 1)
        regime = (0 if x > 0 else 1) + (0 if y > 0 else 2)
        if regime == 3 and draw.random() < 0.7:
            continue
        out.append(("s" if i % 3 else "t", datetime(2024, 1, 1) + timedelta(hours=i), regime, 1.0, x, y, draw.random()))
    return spark.createDataFrame(out, SCHEMA).cache()


@pytest.fixture(scope="module")
def fitted(rows):
    return M.ml_train(rows, ["x", "y", "noise"], SMALL)


def test_probabilities_come_from_the_margins(rows, fitted):
    """Each class's margin by hand: the sum of its trees' votes, through the logistic curve, scaled to 1."""
    out = fitted.transform(rows).withColumn("p", vector_to_array("probability")).withColumn("f", vector_to_array("features")).collect()
    for r in out[:40]:
        shares = []
        for c in range(4):
            model = fitted.model.models[c]
            margin = sum(w * t.predict(Vectors.dense(r.f)) for w, t in zip(model.treeWeights, model.trees))
            shares.append(1 / (1 + np.exp(-2 * margin)))
        assert r.p == pytest.approx([s / sum(shares) for s in shares], abs=1e-9)
        assert r.prediction == float(np.argmax(r.p))
    right = np.mean([r.prediction == r.regime for r in out])
    assert right > 0.9


def test_importances_add_up_and_find_the_features(spark, fitted):
    table = {r.feature: r.importance for r in M.feature_importance(spark, fitted).collect()}
    assert sum(table.values()) == pytest.approx(1) and min(table["x"], table["y"]) > 5 * table["noise"]
    assert {r.feature for r in M.top_features(M.feature_importance(spark, fitted), 2).collect()} == {"x", "y"}


@pytest.mark.parametrize("p", [SMALL, M.Params(max_depth=3, n_estimators=4, boosted=False)])
def test_a_loaded_model_is_the_same(spark, rows, tmp_path, p):
    model = M.ml_train(rows, ["x", "y", "noise"], p)
    M.ml_save(spark, model, str(tmp_path / "m"))
    loaded = M.ml_load(spark, str(tmp_path / "m"))
    columns = ["ts", "prediction", "p_0", "p_1", "p_2", "p_3"]
    assert sorted(M.ml_proba(loaded, rows).select(*columns).collect()) == sorted(M.ml_proba(model, rows).select(*columns).collect())
    assert loaded.params == p and M.feature_importance(spark, loaded).collect() == M.feature_importance(spark, model).collect()


def test_absent_classes_have_no_probability(rows):
    some = rows.filter("regime IN (0, 2)")
    model = M.ml_train(some, ["x", "y"], SMALL)
    out = M.ml_proba(model, rows).collect()
    assert set(model.model.models) == {0, 2}
    assert all(r.p_1 == r.p_3 == 0.0 and r.p_0 + r.p_2 == pytest.approx(1) for r in out)


def test_only_live_parameters_are_searched():
    boosted, forest = M.search_table(20), M.search_table(20, boosted=False)
    assert len({p.learning_rate for p in boosted}) == 20 and {p.learning_rate for p in forest} == {M.Params().learning_rate}
    assert all(0.005 <= p.learning_rate <= 0.3 and 100 <= p.n_estimators <= 800 and 3 <= p.max_depth <= 12 for p in boosted)
    assert M.search_table(20) == boosted


def test_learning_rate_changes_the_score(rows):
    import json
    from dataclasses import replace

    candidates = [replace(SMALL, learning_rate=rate, max_depth=2, n_estimators=3) for rate in (0.01, 0.9)]
    tuned = M.ml_tune(rows, ["x", "y"], candidates, 2).collect()
    assert len(tuned) == 2 and all(0 <= r.mean_f1 <= 1 for r in tuned) and tuned[0].mean_f1 >= tuned[1].mean_f1
    assert {json.loads(r.params)["learning_rate"] for r in tuned} == {0.01, 0.9}
    assert M.best_of(M.ml_tune(rows, ["x", "y"], candidates[1:], 2)) == candidates[1]
