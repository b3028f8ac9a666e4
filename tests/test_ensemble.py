"""The calibrated ensemble: isotonic first, sigmoid if it fails, stored and
read again, importances averaged over the folds."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleflow.operators import ensemble as E
from candleflow.operators import models as ML

FEATS = [f"x{i}" for i in range(8)]
SMALL = {"extra_trees": {"n_estimators": 12, "max_depth": 6},
         "boosted": {"n_estimators": 8, "num_leaves": 7, "min_child_samples": 5, "learning_rate": 0.3}}


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(42)
    x = rng.standard_normal((220, 8))
    y = (x[:, 0] + 0.35 * x[:, 1] - 0.15 * x[:, 2] > 0).astype(int)
    rows = [("S", dt.date(2020, 1, 1) + dt.timedelta(days=i), *map(float, x[i]), int(y[i])) for i in range(220)]
    df = spark.createDataFrame(rows, "symbol string, ts date, " + ", ".join(f"{c} double" for c in FEATS) + ", target int")
    df = ML.assemble(df, FEATS).withColumn("weight", F.lit(1.0))
    cut = dt.date(2020, 1, 1) + dt.timedelta(days=190)
    return df.filter(F.col("ts") < cut), df.filter(F.col("ts") >= cut)


@pytest.mark.parametrize("trainer", ["extra_trees", "boosted"])
def test_stored_and_scored_again(spark, frames, tmp_path, trainer):
    train, test = frames
    model = E.fit_calibrated(train, FEATS, trainer, SMALL[trainer])
    assert model.method == "isotonic" and len(model.members) == 3
    path = str(tmp_path / trainer)
    model.save(spark, path)
    again = E.CalibratedEnsemble.load(spark, path)
    assert again.params == model.params and again.columns == FEATS
    a, b = ({r["ts"]: (r["prob_up"], r["prediction"], r["confidence"]) for r in m.score(test).collect()}
            for m in (model, again))
    assert a == b and len(a) == 30
    assert all(0 <= p <= 1 and d == int(p >= 0.5) and c == max(p, 1 - p) for p, d, c in a.values())
    hit = np.mean([(r["label"] == r["prediction"]) for r in again.score(test).collect()])
    assert hit > 0.6
    imp = {r["feature"]: r["importance"] for r in again.importances(spark).collect()}
    assert set(imp) == set(FEATS) and abs(sum(imp.values()) - 1) < 1e-9 and max(imp, key=imp.get) == "x0"


def test_average_of_the_folds_calibrated_scores(spark, frames):
    train, test = frames
    model = E.fit_calibrated(train, FEATS, "extra_trees", SMALL["extra_trees"])
    want = {}
    for base, c in model.members:
        for r in base.with_probability(test).collect():
            want.setdefault(r["ts"], []).append(float(np.clip(np.interp(r["prob_up"], c.x, c.y), 0, 1)))
    for r in model.score(test).collect():
        assert r["prob_up"] == pytest.approx(np.mean(want[r["ts"]]))


def test_falls_back_to_sigmoid(frames):
    train, test = frames

    def broken(_):
        raise ValueError("isotonic calibration failed")
    model = E.fit_calibrated(train, FEATS, "extra_trees", SMALL["extra_trees"],
                             fitters={"isotonic": broken, "sigmoid": ML._sigmoid})
    assert model.method == "sigmoid"
    assert all(0.0 <= r["prob_up"] <= 1.0 for r in model.score(test).collect())
    with pytest.raises(ValueError):
        E.fit_calibrated(train, FEATS, "extra_trees", SMALL["extra_trees"],
                         fitters={"isotonic": broken, "sigmoid": broken})
