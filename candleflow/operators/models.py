"""Model operators on pyspark.ml: dataset assembly, forest / boosted-tree
fits, walk-forward random search, fold-wise calibration, scoring, the run
ledger and the champion rule.

One pooled model is fitted over the whole panel; split and fold dates come
from :mod:`candleflow.operators.dataset`, so no row ever trains a model that
is evaluated on an earlier row of any series.  Driver-side loops run over
*folds and trials* (a handful of Spark jobs), never over rows.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.errors import IllegalArgumentException
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleflow.operators import dataset as D
from candleflow.plans.series import KEY
from candleflow.session import cut_lineage

# Reference defaults (extremely randomised trees -> random forest without
# bootstrap; Spark caps tree depth at 30).
FOREST_DEFAULTS = {"numTrees": 300, "maxDepth": 30, "featureSubsetStrategy": "sqrt",
                   "bootstrap": False, "minInstancesPerNode": 1, "seed": 42}
GBT_DEFAULTS = {"maxIter": 500, "stepSize": 0.03, "maxDepth": 5, "minInstancesPerNode": 20,
                "minInfoGain": 0.01, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
                "maxBins": 127, "seed": 42}
N_TRIALS = 60
TOP_K = 15


def assemble(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    va = VectorAssembler(inputCols=list(feature_cols), outputCol="features", handleInvalid="keep")
    return va.transform(df).withColumn("label", F.col("target").cast("double"))


def training_sets(features: DataFrame, feature_cols: list[str]):
    """(train, test) with ``features``/``label``/``weight`` columns.

    train = the panel's dates before the embargo, weighted by decay x balanced
    class weight; test = the newest 20 % of the dates.
    """
    lab = D.chrono_split(D.training_window(D.labelled_rows(features)))
    train = D.class_weights(D.sample_weights(lab.filter(F.col("split") == "train").drop("split")))
    test = lab.filter(F.col("split") == "test").drop("split")
    return assemble(train, feature_cols), assemble(test, feature_cols)


def forest(params: dict | None = None) -> RandomForestClassifier:
    p = {**FOREST_DEFAULTS, **(params or {})}
    return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", **p)


def gbt(params: dict | None = None) -> GBTClassifier:
    p = {**GBT_DEFAULTS, **(params or {})}
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", **p)


def score(model, df: DataFrame) -> DataFrame:
    """ML12: prediction and P(up); confidence = row-max probability."""
    out = model.transform(df)
    p = vector_to_array("probability")
    return (out.withColumn("prob_up", p[1])
            .withColumn("confidence", F.greatest(p[0], p[1]))
            .withColumn("prediction", F.col("prediction").cast("int")))


def evaluate(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy / precision / recall / F1 and exact ROC-AUC as one table."""
    s = scored.withColumn("target", F.col("label").cast("int")).withColumn("score", F.col("prob_up"))
    key = by or []
    if not key:
        s = s.withColumn("_all", F.lit("all"))
        key = ["_all"]
    m = D.binary_metrics(s, by=tuple(key))
    auc = D.roc_auc(s, by=key[0]) if len(key) == 1 else None
    out = m.join(auc, key[0]) if auc is not None else m
    return out.drop("_all") if "_all" in out.columns else out


def importances(model, feature_cols: list[str]) -> DataFrame:
    """ML15: (feature, importance); one row per feature column."""
    from pyspark.sql import SparkSession
    vals = model.featureImportances.toArray().tolist()
    ss = SparkSession.getActiveSession()
    return ss.createDataFrame(list(zip(feature_cols, [float(v) for v in vals])),
                              "feature string, importance double")


def top_importances(imp: DataFrame, k: int = TOP_K, ascending: bool = False) -> DataFrame:
    """The k largest (or smallest) importances (TakeOrdered)."""
    by = F.col("importance").asc() if ascending else F.col("importance").desc()
    return imp.orderBy(by, "feature").limit(k).withColumn("importance", F.round("importance", 6))


# ------------------------------------------------------------------ calibration

def _isotonic(cal: DataFrame):
    return IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(cal)


def _sigmoid(cal: DataFrame):
    lr = LogisticRegression(featuresCol="rawv", labelCol="label", weightCol="weight")
    return lr.fit(cal.withColumn("rawv", array_to_vector(F.array("raw"))))


def _apply_calibrator(cal_model, method: str, df: DataFrame) -> DataFrame:
    if method == "isotonic":
        return cal_model.transform(df).withColumn("_p", F.least(F.greatest(F.col("prediction"), F.lit(0.0)),
                                                                 F.lit(1.0))).drop("prediction")
    out = cal_model.transform(df.withColumn("rawv", array_to_vector(F.array("raw"))))
    return out.withColumn("_p", vector_to_array("probability")[1]) \
        .drop("prediction", "probability", "rawPrediction", "rawv")


def calibrate(folds: list[tuple[DataFrame, DataFrame]], fitters=None) -> tuple[DataFrame, str]:
    """ML11 on scores: per fold, a calibrator fitted on the held-out rows
    (``raw``, ``label``, ``weight``) is applied to the rows to score (key,
    ``ts``, ``raw``); probabilities are averaged over folds.  Isotonic first,
    sigmoid if the isotonic fit fails on any fold.
    """
    fitters = fitters or {"isotonic": _isotonic, "sigmoid": _sigmoid}
    last_error = None
    for method in ("isotonic", "sigmoid"):
        try:
            cals = [fitters[method](held) for held, _ in folds]
        except (ValueError, IllegalArgumentException) as exc:  # the fit itself, not a lost executor
            last_error = exc
            continue
        probs = None
        for (_, rows), cal in zip(folds, cals):
            p = _apply_calibrator(cal, method, rows).select(KEY, "ts", F.col("_p"))
            probs = p if probs is None else probs.unionByName(p)
        return probs.groupBy(KEY, "ts").agg(F.avg("_p").alias("prob_up")), method
    raise last_error


def calibrated_scores(train: DataFrame, test: DataFrame, base_params: dict | None = None,
                      fitters=None) -> tuple[DataFrame, str]:
    """ML11: per calibration fold, fit the base model on the fold's train rows
    and a calibrator on its held-out rows (see :func:`calibrate`)."""
    folds = []
    for role in D.calibration_roles(train):
        base = forest(base_params).fit(train.filter(role == "train"))
        held = score(base, train.filter(role == "test")).select(F.col("prob_up").alias("raw"), "label", "weight")
        folds.append((held, score(base, test).select(KEY, "ts", F.col("prob_up").alias("raw"))))
    avg, method = calibrate(folds, fitters)
    return test.select(KEY, "ts", "label").join(avg, [KEY, "ts"]).withColumn("method", F.lit(method)), method


# ------------------------------------------------------------------ random search

def sample_params(rng: random.Random) -> dict:
    """One draw from the forest search space (seeded), mapped to Spark."""
    def log_uniform(a, b):
        return math.exp(rng.uniform(math.log(a), math.log(b)))
    limit = rng.choice([True, False])
    boot = rng.choice([True, False])
    p = {"numTrees": int(round(log_uniform(100, 1000))),
         "maxDepth": min(rng.randint(3, 40), 30) if limit else 30,
         "minInstancesPerNode": rng.randint(1, 20),
         "featureSubsetStrategy": f"{log_uniform(0.05, 1.0):.4f}",
         "impurity": rng.choice(["gini", "entropy"]),
         "bootstrap": boot}
    if boot:
        p["subsamplingRate"] = rng.uniform(0.6, 1.0)
    return p


def sample_gbt_params(rng: random.Random) -> dict:
    """One draw from the boosted-tree search space (seeded), mapped to Spark."""
    def log_uniform(a, b):
        return math.exp(rng.uniform(math.log(a), math.log(b)))
    return {"maxIter": int(round(log_uniform(100, 1000))), "stepSize": log_uniform(0.005, 0.2),
            "maxDepth": rng.randint(3, 8), "minInstancesPerNode": rng.randint(5, 60),
            "subsamplingRate": rng.uniform(0.6, 1.0),
            "featureSubsetStrategy": f"{rng.uniform(0.4, 1.0):.4f}"}


#: trainer -> (estimator from parameters, search space)
TRAINERS = {"forest": (forest, sample_params), "gbt": (gbt, sample_gbt_params)}


def random_search(train: DataFrame, n_trials: int = N_TRIALS, seed: int = 42,
                  trainer: str = "forest", space=None, parallel: int = 2) -> DataFrame:
    """ML10: maximise mean walk-forward AUC; every trial's metrics kept.

    Trials are independent Spark jobs submitted from a small thread pool over
    one written copy of the training rows; folds are date filters on it.
    Folds whose train or test rows have one class only are left out of the
    means.  ``space`` replaces the trainer's search space.
    """
    data = cut_lineage(train)
    roles = D.fold_roles(data, D.WF_SPLITS, D.WF_GAP)
    both = F.countDistinct("label") == 2
    usable = [r for r in roles if all(
        data.filter(r == part).agg(both.alias("b")).first()["b"] for part in ("train", "test"))]
    estimator, own_space = TRAINERS[trainer]
    rng = random.Random(seed)
    trials = [(space or own_space)(rng) for _ in range(n_trials)]

    def run(i_params):
        i, params = i_params
        evs = []
        for role in usable:
            m = estimator(params).fit(data.filter(role == "train"))
            evs.append(evaluate(score(m, data.filter(role == "test"))).first())
        mean = lambda key: sum(e[key] for e in evs) / len(evs) if evs else None
        return (i, json.dumps(params, sort_keys=True), len(evs), mean("precision"), mean("recall"), mean("roc_auc"))

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        rows = list(pool.map(run, enumerate(trials)))
    return train.sparkSession.createDataFrame(
        rows, "trial int, params string, n_folds int, cv_precision double, cv_recall double, cv_roc_auc double")


# ------------------------------------------------------------------ ledger / champion

def run_id(model_name: str, version: int, trained_ms: int) -> str:
    """Differs between two trainings of the same parameters."""
    return hashlib.sha256(f"{model_name}:{version}:{trained_ms}".encode()).hexdigest()[:16]


def _wins(champion, new, force: bool = False):
    """ML17: no champion, its feature count unknown or another, a strictly
    better AUC, or ``force``."""
    return (champion["version"].isNull() | champion["n_features"].isNull()
            | ~champion["n_features"].eqNullSafe(new["n_features"])
            | (new["roc_auc"] > champion["roc_auc"]) | F.lit(force))


def promotion_decision(runs: DataFrame, force: bool = False) -> DataFrame:
    """ML17/ML18: the champion rule over a ledger.

    Runs are registered in version order.  The champion is the run in
    production, the last one promoted; each new run is compared with it.  A
    rejected run stays a candidate and changes nothing else; a promoted one
    archives the champion, whose metrics and parameters stay in the ledger.
    A ledger with a ``status`` column keeps its decisions: runs that have a
    status are not decided again.  One row per model gathers its versions (as
    many as trainings), never data rows.
    """
    known = "status" in runs.columns
    cols = [c for c in runs.columns if c not in ("model_name", "status", "promoted")]
    entry = F.struct(*cols, (F.col("status") if known else F.lit(None).cast("string")).alias("status"))
    ledger = runs.groupBy("model_name").agg(F.array_sort(F.collect_list(
        F.struct(F.col("version").alias("_v"), entry.alias("run")))).alias("_l"))
    none = F.lit(None)
    start = F.struct(none.cast("int").alias("version"), none.cast("double").alias("roc_auc"),
                     none.cast("int").alias("n_features"), F.array().cast("array<int>").alias("won"))

    def step(acc, x):
        run = x["run"]
        decided = run["status"].isNotNull()
        won = F.when(decided, run["status"].isin("production", "archived")).otherwise(_wins(acc, run, force))
        pick = lambda field, kind: F.when(won, run[field].cast(kind)).otherwise(acc[field]).alias(field)
        return F.struct(pick("version", "int"), pick("roc_auc", "double"), pick("n_features", "int"),
                        F.when(won, F.concat(acc["won"], F.array(run["version"].cast("int"))))
                        .otherwise(acc["won"]).alias("won"))

    done = ledger.withColumn("_c", F.aggregate("_l", start, step))
    rows = done.select("model_name", "_c", F.explode("_l").alias("_x"))
    version = F.col("_x.run.version").cast("int")
    promoted = F.array_contains("_c.won", version)
    status = F.when(version == F.col("_c.version"), "production").when(promoted, "archived").otherwise("candidate")
    return rows.select("model_name", *[F.col(f"_x.run.{c}").alias(c) for c in cols],
                       status.alias("status"), promoted.alias("promoted"))


def latest_model(runs: DataFrame) -> DataFrame:
    """Newest version per model (max version)."""
    best = F.max_by(F.struct(*[c for c in runs.columns if c != "model_name"]), F.col("version"))
    return runs.groupBy("model_name").agg(best.alias("_r")).select("model_name", "_r.*")


def model_card(runs: DataFrame) -> DataFrame:
    """ML19: latest run per model with short name and training date."""
    lm = latest_model(runs)
    return lm.select(
        "model_name",
        F.regexp_replace("model_name", "(Classifier|Regressor)$", "").alias("short_name"),
        # days since 1970 in UTC, whatever the session's time zone
        F.date_format(F.date_add(F.lit("1970-01-01").cast("date"),
                                 F.floor(F.col("trained_ms") / 86_400_000).cast("int")), "yyyy-MM-dd").alias("trained"),
        "version", "accuracy", "f1", "precision", "recall", "roc_auc")
