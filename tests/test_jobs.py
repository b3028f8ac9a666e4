"""The three jobs end to end on the smallest driver scale."""

import os
import uuid
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from candleflow import checkpoint_dir, jobs
from candleflow.operators.search import Param
from candleflow.sources.store import TableStore

SF = "/root/testdata/sf0.001"
SIDE = ["AO", "NF", "NO", "RF", "RO"]


def forbidden(monkeypatch):
    """No estimator of any kind may be fitted."""
    from pyspark.ml import Estimator

    from candleflow.operators import boosting, ensemble, trees

    def refuse(*_, **__):
        raise AssertionError("a model was fitted")

    patch = monkeypatch.context()
    inner = patch.__enter__()
    inner.setattr(Estimator, "fit", refuse)
    for module, name in ((ensemble, "fit_calibrated"), (trees, "fit_extra_trees"), (boosting, "fit_boosted")):
        inner.setattr(module, name, refuse)
    inner.setattr(ensemble, "TRAINERS", {k: replace(t, fit=refuse) for k, t in ensemble.TRAINERS.items()})

    class _Undo:
        def __enter__(self):
            return self

        def __exit__(self, *exc):
            return patch.__exit__(*exc)

    return _Undo()


@pytest.mark.skipif(not os.path.exists(SF), reason="driver data not present")
def test_build_train_predict(spark, monkeypatch):
    store = TableStore(spark, f"{checkpoint_dir(spark)}/jobs-{uuid.uuid4().hex}")
    feats = jobs.build_features(spark, SF, store, SIDE)
    assert feats.count() > 0
    tiny = {"n_estimators": Param(4, 8, whole=True), "max_depth": Param(3, 4, whole=True)}
    r1 = jobs.train(spark, store, n_trials=1, space=tiny)
    assert r1["version"] == 1 and r1["promoted"]
    r2 = jobs.train(spark, store, params={"n_estimators": 8, "max_depth": 4})
    assert r2["run_id"] != r1["run_id"]
    runs = {r.version: r.status for r in store.load("model_runs").collect()}
    assert r2["version"] == 2 and set(runs) == {1, 2}
    assert sorted(runs.values()).count("production") == 1
    imp = jobs.importances(spark, store).collect()
    assert len(imp) == r1["n_features"] and abs(sum(r["importance"] for r in imp) - 1) < 1e-9
    with forbidden(monkeypatch):
        preds = jobs.predict_latest(spark, store)
    newest = feats.groupBy("symbol").agg(F.max("ts").alias("ts"))
    assert preds.join(newest, ["symbol", "ts"]).count() == newest.count()
    out = jobs.outcomes(spark, store)
    assert out.filter(F.col("status") == "open").count() >= newest.count()
    conf = preds.join(newest, ["symbol", "ts"]).agg(F.min("confidence"), F.max("confidence")).first()
    assert 0.5 <= conf[0] <= conf[1] <= 1.0
    # features that differ from those of the model in production are refused
    store.save("features", store.load("features").withColumnRenamed("rsi", "rsi_14"))
    with pytest.raises(ValueError, match="drift"):
        jobs.predict_latest(spark, store)
