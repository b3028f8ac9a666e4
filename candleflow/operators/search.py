"""Model-based hyper-parameter search (ML10) over a table of trials.

A search is a table with a row per trial (number, parameters, value).  What is
asked next is a function of the seed, the trial's number and the rows before
its batch, so a search that was broken off goes on from its table and gives
the same trials as one that was not.

The first ``STARTUP`` trials are drawn at random.  After that the trials are cut
at the best ``good_count`` values: for every parameter one density is fitted to
the good trials and one to the others (Gaussian kernels on the unit interval,
on a log scale where the range is logarithmic, and counts for choices; both
with a flat prior); ``CANDIDATES`` values are drawn from the good density and
the one with the largest ratio of the two is asked.  Trials of a batch are
asked from the same rows and evaluated at the same time.

A parameter may hang on another's value (``when``); its densities see only the
trials in which it was active, and it is None where it is not.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleflow.operators import dataset as D
from candleflow.session import cut_lineage

STARTUP = 10
CANDIDATES = 24
BATCH = 4
N_TRIALS = 60


@dataclass(frozen=True)
class Param:
    low: float = 0.0
    high: float = 1.0
    log: bool = False
    whole: bool = False
    choices: tuple = ()
    when: tuple | None = None  # (other parameter, value)

    def unit(self, value) -> float:
        a, b, v = (math.log(x) for x in (self.low, self.high, value)) if self.log else (self.low, self.high, value)
        return (v - a) / (b - a) if b > a else 0.0

    def value(self, u: float):
        u = min(1.0, max(0.0, u))
        if self.log:
            v = math.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        else:
            v = self.low + u * (self.high - self.low)
        v = min(self.high, max(self.low, v))
        return int(round(v)) if self.whole else v


#: fixed values: the documented search ranges of the two trainers
EXTRA_TREES_SPACE = {
    "limit_depth": Param(choices=(True, False)),
    "bootstrap": Param(choices=(True, False)),
    "n_estimators": Param(100, 1000, log=True, whole=True),
    "max_depth": Param(3, 40, whole=True, when=("limit_depth", True)),
    "min_samples_split": Param(2, 20, whole=True),
    "min_samples_leaf": Param(1, 20, whole=True),
    "max_features": Param(0.05, 1.0, log=True),
    "criterion": Param(choices=("gini", "entropy")),
    "max_samples": Param(0.6, 1.0, when=("bootstrap", True)),
}
BOOST_SPACE = {
    "n_estimators": Param(100, 1500, log=True, whole=True),
    "learning_rate": Param(0.005, 0.15, log=True),
    "max_depth": Param(3, 12, whole=True),
    # of the leaves that the depth allows, from 15 (or all) to 255
    "num_leaves": Param(15, 255, whole=True),
    "min_child_samples": Param(10, 100, whole=True),
    "min_gain_to_split": Param(1e-4, 1.0, log=True),
    "subsample": Param(0.5, 1.0),
    "colsample_bytree": Param(0.3, 1.0),
    "reg_alpha": Param(1e-4, 10.0, log=True),
    "reg_lambda": Param(1e-2, 50.0, log=True),
    "path_smooth": Param(0.0, 10.0),
    "max_bin": Param(choices=(63, 127, 255)),
}


def good_count(n: int) -> int:
    return min(25, math.ceil(0.1 * n))


class _Kernels:
    """Gaussian kernels at the observed points and a broad one in the middle,
    cut at the ends of the unit interval."""

    def __init__(self, points: list[float]) -> None:
        at = np.sort(np.asarray([*points, 0.5]))
        edges = np.concatenate(([0.0], at, [1.0]))
        width = np.maximum(at - edges[:-2], edges[2:] - at)
        least = 1.0 / min(100, len(at) + 1)
        self.at = at
        self.width = np.clip(width, least, 1.0)
        self.width[int(np.searchsorted(at, 0.5))] = 1.0
        self.mass = self._below((1 - at) / self.width) - self._below(-at / self.width)

    @staticmethod
    def _below(z):
        return np.array([0.5 * (1 + math.erf(v / math.sqrt(2))) for v in np.atleast_1d(z)])

    def draw(self, rng, size: int) -> np.ndarray:
        out = []
        while len(out) < size:
            k = rng.integers(len(self.at))
            v = rng.normal(self.at[k], self.width[k])
            if 0 <= v <= 1:
                out.append(v)
        return np.array(out)

    def log_density(self, u) -> np.ndarray:
        z = (np.asarray(u)[:, None] - self.at[None, :]) / self.width[None, :]
        d = np.exp(-0.5 * z * z) / (self.width * math.sqrt(2 * math.pi) * self.mass)[None, :]
        return np.log(d.mean(1) + 1e-300)


def _active(p: Param, chosen: dict) -> bool:
    return p.when is None or chosen.get(p.when[0]) == p.when[1]


def suggest(space: dict[str, Param], history: list[tuple[dict, float | None]], number: int, seed: int = 42,
            random_only: bool = False) -> dict:
    """Parameters of trial ``number`` after ``history`` (parameters, value;
    a trial without a value counts as the worst)."""
    rng = np.random.default_rng([seed, number])
    done = sorted(((-math.inf if v is None else v), i, p) for i, (p, v) in enumerate(history))[::-1]
    informed = not random_only and len(done) >= STARTUP
    good = [p for *_, p in done[:good_count(len(done))]]
    rest = [p for *_, p in done[good_count(len(done)):]]
    chosen: dict = {}
    for name, p in space.items():
        if not _active(p, chosen):
            chosen[name] = None
        elif p.choices:
            if informed:
                def shares(trials):
                    n = np.array([1.0 + sum(t.get(name) == c for t in trials) for c in p.choices])  # noqa: B023
                    return n / n.sum()
                a, b = shares(good), shares(rest)
                drawn = rng.choice(len(p.choices), CANDIDATES, p=a)
                chosen[name] = p.choices[int(drawn[np.argmax((a / b)[drawn])])]
            else:
                chosen[name] = p.choices[int(rng.integers(len(p.choices)))]
        elif informed:
            a, b = (_Kernels([p.unit(t[name]) for t in trials if t.get(name) is not None]) for trials in (good, rest))
            u = a.draw(rng, CANDIDATES)
            chosen[name] = p.value(float(u[np.argmax(a.log_density(u) - b.log_density(u))]))
        else:
            chosen[name] = p.value(float(rng.random()))
    return _consistent(chosen)


def _consistent(chosen: dict) -> dict:
    """Leaves no more than the depth holds."""
    if chosen.get("num_leaves") and chosen.get("max_depth"):
        chosen["num_leaves"] = min(chosen["num_leaves"], 2 ** chosen["max_depth"])
    return chosen


def optimise(space: dict[str, Param], evaluate: Callable[[dict], dict], n_trials: int = N_TRIALS, seed: int = 42,
             batch: int = BATCH, before: list[dict] | None = None, keep: Callable[[list[dict]], None] | None = None,
             random_only: bool = False, parallel: int = 2) -> list[dict]:
    """Rows ``{"trial", "params", "value", ...}``, of which ``evaluate`` gives
    ``value`` and whatever else.  ``before`` are rows of an earlier call, of which
    whole batches are taken over; ``keep`` is told all rows after each batch."""
    rows = sorted(before or [], key=lambda r: r["trial"])
    rows = rows[:len(rows) - len(rows) % batch] if len(rows) < n_trials else rows[:n_trials]
    while len(rows) < n_trials:
        history = [(r["params"], r["value"]) for r in rows]
        asked = [suggest(space, history, i, seed, random_only)
                 for i in range(len(rows), min(n_trials, len(rows) + batch))]
        with ThreadPoolExecutor(max_workers=parallel) as pool:
            results = list(pool.map(evaluate, asked))
        rows = rows + [{"trial": len(rows) + i, "params": p, **r} for i, (p, r) in enumerate(zip(asked, results))]
        if keep:
            keep(rows)
    return rows


SCHEMA = "trial int, params string, n_folds int, cv_precision double, cv_recall double, cv_roc_auc double"


def trial_table(spark, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["trial"], json.dumps(r["params"], sort_keys=True), r["n_folds"], r["precision"],
                                   r["recall"], r["value"]) for r in rows], SCHEMA)


def trial_rows(table: DataFrame) -> list[dict]:
    return [{"trial": r["trial"], "params": json.loads(r["params"]), "n_folds": r["n_folds"],
             "precision": r["cv_precision"], "recall": r["cv_recall"], "value": r["cv_roc_auc"]}
            for r in table.collect()]


def tune(train: DataFrame, trainer: str = "extra_trees", n_trials: int = N_TRIALS, seed: int = 42,
         space: dict[str, Param] | None = None, batch: int = BATCH, store=None, name: str = "trials",
         parallel: int = 2) -> DataFrame:
    """ML10: the trials of a search that maximises the mean walk-forward AUC of
    a trainer (see :data:`~candleflow.operators.ensemble.TRAINERS`).

    Folds are date filters on one written copy of the training rows; folds of
    which a side has one class only are left out of the means.  With a table
    store, the trials are saved after every batch and a later call goes on from
    them."""
    from candleflow.operators import models as ML
    from candleflow.operators.ensemble import TRAINERS

    kind = TRAINERS[trainer]
    data = cut_lineage(train)
    both = F.countDistinct("label") == 2
    usable = [role for role in D.fold_roles(data, D.WF_SPLITS, D.WF_GAP) if all(
        data.filter(role == part).agg(both.alias("b")).first()["b"] for part in ("train", "test"))]

    def evaluate(params: dict) -> dict:
        got = []
        for role in usable:
            model = kind.fit(data.filter(role == "train"), params)
            scored = model.with_probability(data.filter(role == "test"))
            got.append(ML.evaluate(scored.withColumn("prediction", (F.col("prob_up") >= 0.5).cast("int"))).first())
        mean = lambda k: sum(g[k] for g in got) / len(got) if got else None
        return {"n_folds": len(got), "precision": mean("precision"), "recall": mean("recall"), "value": mean("roc_auc")}

    before = None
    if store is not None:
        try:
            before = trial_rows(store.load(name))
        except FileNotFoundError:
            before = None
    keep = (lambda rows: store.save(name, trial_table(train.sparkSession, rows))) if store is not None else None
    rows = optimise(space or kind.space, evaluate, n_trials, seed, batch, before, keep, parallel=parallel)
    return trial_table(train.sparkSession, rows)


def best_params(trials: DataFrame) -> dict:
    """Of the best mean AUC; of equal ones the earliest."""
    best = trials.orderBy(F.col("cv_roc_auc").desc_nulls_last(), "trial").first()
    return json.loads(best["params"])
