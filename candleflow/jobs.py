"""End-to-end jobs: feature build, training, prediction.

Each job is a handful of Spark jobs over the panel; tables go through the
versioned :class:`~candleflow.sources.store.TableStore` (never overwriting the
version being read), models through the ensemble's own writer and reader.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleflow.operators import ensemble as EN
from candleflow.operators import features as FT
from candleflow.operators import models as ML
from candleflow.operators import outcomes as O
from candleflow.operators import search as SR
from candleflow.session import cut_lineage
from candleflow.sources import bars as S
from candleflow.sources.store import TableStore


def feature_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in ("symbol", "ts", "target")]


def build_features(spark: SparkSession, sf_dir: str, store: TableStore,
                   side_symbols: list[str]) -> DataFrame:
    """Raw bars -> store; feature table + manifest -> store."""
    bars = S.indexed_bars(spark, sf_dir)
    store.save("bars_daily", bars.drop("bar_no"), partition_by=["symbol"])
    feats = FT.feature_table(bars, side_symbols)
    store.save("features", feats)
    feats = store.load("features")
    store.save("feature_manifest", FT.manifest(feats))
    return feats


def train(spark: SparkSession, store: TableStore, trainer: str = "extra_trees", model_name: str | None = None,
          n_trials: int = SR.N_TRIALS, space=None, params: dict | None = None, force: bool = False) -> dict:
    """Tune (model-based walk-forward search; skipped when ``params`` is given),
    fit the calibrated ensemble, evaluate it on the hold-out, store it, append to
    the run ledger and apply the champion rule.

    ``trainer`` is a name of :data:`~candleflow.operators.ensemble.TRAINERS`.
    The trials of a search are kept under the run's version, so a training
    that was broken off goes on from them.  The training columns are stored
    with the run: scoring compares with them.
    """
    model_name = model_name or EN.TRAINERS[trainer].name
    feats = store.load("features")
    cols = feature_columns(feats)
    train_df, test_df = ML.training_sets(feats, cols)
    train_df, test_df = cut_lineage(train_df), cut_lineage(test_df)
    try:
        prev = store.load("model_runs")
        version = (prev.filter(F.col("model_name") == model_name).agg(F.max("version")).first()[0] or 0) + 1
    except FileNotFoundError:
        prev, version = None, 1
    if params is None:
        trials = SR.tune(train_df, trainer, n_trials, space=space, store=store, name=f"trials_{model_name}_{version}")
        params = SR.best_params(trials)
    model = EN.fit_calibrated(train_df, cols, trainer, params)
    m = ML.evaluate(model.score(test_df)).first()
    now = int(time.time() * 1000)
    run_id = ML.run_id(model_name, version, now)
    path = f"{store.root}/models/{model_name}/v={version}-{run_id}"
    model.save(spark, path)
    run = {"model_name": model_name, "version": version, "accuracy": m["accuracy"], "f1": m["f1"],
           "precision": m["precision"], "recall": m["recall"], "roc_auc": m["roc_auc"],
           "n_features": len(cols), "trained_ms": now,
           "params": json.dumps({**model.params, "probability_calibration": model.method}, sort_keys=True),
           "run_id": run_id, "column_hash": FT.manifest_hash_py(feats.columns), "model_path": path}
    row = spark.createDataFrame([run])
    runs = row if prev is None else prev.drop("promoted").unionByName(row, allowMissingColumns=True)
    decided = cut_lineage(ML.promotion_decision(runs, force=force))
    store.save("model_runs", decided)
    mine = decided.filter((F.col("model_name") == model_name) & (F.col("version") == version)).first()
    return {**run, "promoted": bool(mine["promoted"])}


def production(store: TableStore, model_name: str):
    """The ledger row of the model in production."""
    prod = (store.load("model_runs").filter((F.col("model_name") == model_name) &
                                            (F.col("status") == "production")).first())
    if prod is None:
        raise LookupError(f"no {model_name} in production")
    return prod


def predict_latest(spark: SparkSession, store: TableStore, trainer: str = "extra_trees",
                   model_name: str | None = None, horizon_days: int = O.HORIZON_DAYS) -> DataFrame:
    """Score the newest feature row of every series with the stored production
    model, without a fit, and upsert the predictions (entry price = that bar's
    close).  The features must have the columns the model was trained on."""
    feats = store.load("features")
    cols = feature_columns(feats)
    prod = production(store, model_name or EN.TRAINERS[trainer].name)
    if FT.manifest_hash_py(feats.columns) != prod["column_hash"]:
        raise ValueError("feature drift: the columns differ from those the model was trained on")
    model = EN.CalibratedEnsemble.load(spark, prod["model_path"])
    newest = feats.groupBy("symbol").agg(F.max("ts").alias("ts"))
    rows = feats.join(newest, ["symbol", "ts"]).withColumn("target", F.lit(None).cast("int"))
    scored = model.score(ML.assemble(rows, cols)).select("symbol", "ts", "prediction", "confidence")
    bars = store.load("bars_daily").select("symbol", "ts", F.col("close").alias("entry_price"))
    new = (scored.join(bars, ["symbol", "ts"], "left")
           .select("symbol", "ts", "prediction", "confidence",
                   F.lit(horizon_days).alias("horizon_days"), "entry_price"))
    return store.upsert("predictions", new, ["symbol", "ts"])


def importances(spark: SparkSession, store: TableStore, trainer: str = "extra_trees",
                model_name: str | None = None) -> DataFrame:
    """Feature importances of the stored production model, averaged over its
    folds."""
    prod = production(store, model_name or EN.TRAINERS[trainer].name)
    return EN.CalibratedEnsemble.load(spark, prod["model_path"]).importances(spark)


def outcomes(spark: SparkSession, store: TableStore) -> DataFrame:
    """Read side: realised outcomes of every stored prediction."""
    return O.prediction_outcomes(store.load("predictions"), store.load("bars_daily"))


__all__ = ["build_features", "train", "predict_latest", "importances", "outcomes"]
