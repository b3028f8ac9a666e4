"""A calibrated tree ensemble that is fitted once, stored, and scored without a
fit (ML11 to ML13, ML15).

For every calibration fold a base model is fitted on the rows before the fold
and a calibrator on the fold's own scores; the probabilities of all folds are
averaged.  Isotonic calibration comes first, a sigmoid if it fails on a fold.
A stored ensemble is a folder: one folder per fold with the base model's node
table, a table of calibrators, and one row of facts.

``TRAINERS`` names the base models; each has a fit function, default
parameters and a search space, so training jobs, search and calibration take
any of them by name.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candleflow.operators import dataset as D
from candleflow.operators import models as ML
from candleflow.operators.boosting import BOOST_DEFAULTS, fit_boosted
from candleflow.operators.search import BOOST_SPACE, EXTRA_TREES_SPACE
from candleflow.operators.trees import EXTRA_TREES_DEFAULTS, TreeModel, fit_extra_trees
from candleflow.session import materialize


@dataclass(frozen=True)
class Trainer:
    name: str
    fit: Callable[[DataFrame, dict | None], TreeModel]
    defaults: dict
    space: dict


TRAINERS = {
    "extra_trees": Trainer("ExtraTreesClassifier", fit_extra_trees, EXTRA_TREES_DEFAULTS, EXTRA_TREES_SPACE),
    "boosted": Trainer("LeafwiseBoostingClassifier", fit_boosted, BOOST_DEFAULTS, BOOST_SPACE),
}


@dataclass
class Calibrator:
    """Isotonic: knots ``x`` with values ``y``, straight lines between them;
    sigmoid: ``x`` is the slope and ``y`` the intercept."""

    method: str
    x: list[float]
    y: list[float]

    def column(self, raw: Column) -> Column:
        if self.method == "sigmoid":
            return 1 / (1 + F.exp(-(raw * self.x[0] + self.y[0])))
        x, y = self.x, self.y

        @F.arrow_udf("double")
        def line(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for a in batches:
                yield pa.array(np.interp(a.to_numpy(zero_copy_only=False), x, y))

        return F.least(F.greatest(line(raw), F.lit(0.0)), F.lit(1.0))


def fit_calibrator(scored: DataFrame, method: str, fitters: dict) -> Calibrator:
    """``scored`` has ``raw``, ``label`` and ``weight``."""
    model = fitters[method](scored)
    if method == "isotonic":
        return Calibrator(method, [float(v) for v in model.boundaries], [float(v) for v in model.predictions])
    return Calibrator(method, [float(model.coefficients[0])], [float(model.intercept)])


@dataclass
class CalibratedEnsemble:
    trainer: str
    params: dict
    columns: list[str]
    members: list[tuple[TreeModel, Calibrator]]

    @property
    def method(self) -> str:
        return self.members[0][1].method

    def score(self, df: DataFrame, features: str = "features") -> DataFrame:
        """ML12: adds ``prob_up``, ``prediction`` and ``confidence`` (the row's
        larger probability)."""
        rows = df.withColumn("prob_up", F.lit(0.0))
        for base, calibrator in self.members:
            rows = base.with_probability(rows, features, "_raw")
            rows = rows.withColumn("prob_up", F.col("prob_up") + calibrator.column(F.col("_raw"))).drop("_raw")
        up = F.col("prob_up") / F.lit(len(self.members))
        rows = rows.withColumn("prob_up", up)
        return rows.withColumns({"prediction": (F.col("prob_up") >= 0.5).cast("int"),
                                 "confidence": F.greatest("prob_up", 1 - F.col("prob_up"))})

    def importances(self, spark: SparkSession) -> DataFrame:
        """ML15: ``(feature, importance)``, averaged over the folds."""
        mean = np.mean([base.importances() for base, _ in self.members], axis=0)
        return spark.createDataFrame([(c, float(v)) for c, v in zip(self.columns, mean)],
                                     "feature string, importance double")

    def save(self, spark: SparkSession, path: str) -> None:
        for i, (base, _) in enumerate(self.members):
            base.save(f"{path}/fold={i}")
        knots = [(i, c.method, c.x, c.y) for i, (_, c) in enumerate(self.members)]
        spark.createDataFrame(knots, "fold int, method string, x array<double>, y array<double>") \
             .coalesce(1).write.parquet(f"{path}/calibrators")
        facts = [(self.trainer, json.dumps(self.params, sort_keys=True), self.columns, len(self.members))]
        # written last: a folder with facts is whole
        spark.createDataFrame(facts, "trainer string, params string, columns array<string>, folds int") \
             .coalesce(1).write.parquet(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CalibratedEnsemble:
        facts = spark.read.parquet(f"{path}/facts").first()
        knots = {r["fold"]: r for r in spark.read.parquet(f"{path}/calibrators").collect()}
        members = [(TreeModel.load(spark, f"{path}/fold={i}"),
                    Calibrator(knots[i]["method"], list(knots[i]["x"]), list(knots[i]["y"])))
                   for i in range(facts["folds"])]
        return cls(facts["trainer"], json.loads(facts["params"]), list(facts["columns"]), members)


def fit_calibrated(train: DataFrame, columns: list[str], trainer: str = "extra_trees", params: dict | None = None,
                   fitters: dict | None = None) -> CalibratedEnsemble:
    """ML11: ``train`` is an assembled, weighted table with ``ts``."""
    fitters = fitters or {"isotonic": ML._isotonic, "sigmoid": ML._sigmoid}
    kind = TRAINERS[trainer]
    settled = {**kind.defaults, **(params or {})}
    bases, held = [], []
    for role in D.calibration_roles(train):
        base = kind.fit(train.filter(role == "train"), settled)
        scored = base.with_probability(train.filter(role == "test"), out="raw")
        bases.append(base)
        held.append(materialize(scored.select("raw", "label", "weight"), "held_out"))
    failed = None
    for method in ("isotonic", "sigmoid"):
        try:
            calibrators = [fit_calibrator(rows, method, fitters) for rows in held]
        except (ValueError, IllegalArgumentException) as exc:  # the fit itself, not a lost executor
            failed = exc
            continue
        return CalibratedEnsemble(trainer, settled, list(columns), list(zip(bases, calibrators)))
    raise failed
