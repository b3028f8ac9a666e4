"""Calibration tests modelled on the reference's own: 220 x 8 standard
normals (seed 42), label x0 + 0.35 x1 - 0.15 x2 > 0; isotonic is used when
possible, a failing isotonic fit falls back to sigmoid; probabilities lie
in [0, 1]."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleflow.operators import models as ML

FEATS = [f"x{i}" for i in range(8)]


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(42)
    x = rng.standard_normal((220, 8))
    y = (x[:, 0] + 0.35 * x[:, 1] - 0.15 * x[:, 2] > 0).astype(int)
    rows = [("S", dt.date(2020, 1, 1) + dt.timedelta(days=i), *map(float, x[i]), int(y[i]))
            for i in range(220)]
    df = spark.createDataFrame(rows, "symbol string, ts date, " +
                               ", ".join(f"{c} double" for c in FEATS) + ", target int")
    df = ML.assemble(df, FEATS).withColumn("weight", F.lit(1.0))
    train = df.filter(F.col("ts") < dt.date(2020, 1, 1) + dt.timedelta(days=215))
    test = df.filter(F.col("ts") >= dt.date(2020, 1, 1) + dt.timedelta(days=215))
    return train, test


def test_isotonic_when_possible(frames):
    train, test = frames
    out, method = ML.calibrated_scores(train, test, {"numTrees": 20, "maxDepth": 5})
    p = [r.prob_up for r in out.collect()]
    assert method == "isotonic"
    assert len(p) == 5 and all(0.0 <= v <= 1.0 for v in p)


def test_falls_back_to_sigmoid(frames):
    train, test = frames

    def broken(_):
        raise ValueError("isotonic calibration failed")
    out, method = ML.calibrated_scores(train, test, {"numTrees": 20, "maxDepth": 5},
                                       fitters={"isotonic": broken, "sigmoid": ML._sigmoid})
    assert method == "sigmoid"
    assert all(0.0 <= r.prob_up <= 1.0 for r in out.collect())


def test_forest_learns_planted_signal(frames):
    train, test = frames
    model = ML.forest({"numTrees": 30, "maxDepth": 6}).fit(train)
    ev = ML.evaluate(ML.score(model, train.unionByName(test))).first()
    assert ev["roc_auc"] > 0.8


def test_promotion_rule(spark):
    runs = spark.createDataFrame([
        ("m", 1, 0.60, None), ("m", 2, 0.70, 10), ("m", 3, 0.65, 10),     # worse -> candidate
        ("n", 1, 0.50, 10), ("n", 2, 0.55, 12),                           # feature count changed
        ("o", 1, 0.40, 10),                                               # no champion
        # the champion is the run in production, not the best AUC of all time
        ("p", 1, 0.80, 10), ("p", 2, 0.60, 12), ("p", 3, 0.70, 12), ("p", 4, 0.65, 12),
    ], "model_name string, version int, roc_auc double, n_features int")
    got = {(r.model_name, r.version): (r.status, r.promoted)
           for r in ML.promotion_decision(runs).collect()}
    assert got[("m", 3)] == ("candidate", False) and got[("m", 2)][0] == "production"
    assert got[("m", 1)][0] == "archived"
    assert got[("n", 2)] == ("production", True) and got[("n", 1)][0] == "archived"
    assert got[("o", 1)] == ("production", True)
    assert [got[("p", v)] for v in (1, 2, 3, 4)] == [
        ("archived", True), ("archived", True), ("production", True), ("candidate", False)]


def test_a_ledger_with_decisions_keeps_them(spark):
    runs = spark.createDataFrame([
        ("m", 1, 0.60, 10, "archived"), ("m", 2, 0.55, 10, "production"),  # was forced
        ("m", 3, 0.90, 10, "candidate"), ("m", 4, 0.57, 10, None)],
        "model_name string, version int, roc_auc double, n_features int, status string")
    got = {r.version: r.status for r in ML.promotion_decision(runs).collect()}
    assert got == {1: "archived", 2: "archived", 3: "candidate", 4: "production"}


def test_run_ids_differ_for_the_same_parameters():
    assert ML.run_id("m", 1, 1000) != ML.run_id("m", 2, 2000)


def test_search_leaves_out_one_class_folds_and_takes_a_trainer(spark):
    rows = [("S", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i % 7), int(i % 7 > 3) if i < 100 else 1)
            for i in range(130)]
    df = spark.createDataFrame(rows, "symbol string, ts date, x0 double, target int")
    df = ML.assemble(df, ["x0"]).withColumn("weight", F.lit(1.0))
    space = lambda rng: {"maxIter": 3, "maxDepth": 2, "minInstancesPerNode": 1, "minInfoGain": 0.0}
    out = ML.random_search(df, n_trials=1, trainer="gbt", space=space).first()
    assert 0 < out["n_folds"] < 5 and out["cv_roc_auc"] > 0.9
    assert "maxIter" in out["params"]
