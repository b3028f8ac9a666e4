"""Model-based search: on a planted optimum, and replayed from its table."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleflow.operators import models as ML
from candleflow.operators import search as S

SPACE = {"x": S.Param(0, 10), "rate": S.Param(1e-4, 1.0, log=True), "k": S.Param(1, 50, whole=True),
         "kind": S.Param(choices=("a", "b", "c")), "deep": S.Param(3, 9, whole=True, when=("kind", "b"))}


def planted(p):
    value = -((p["x"] - 7) / 10) ** 2 - (math.log10(p["rate"]) + 2.5) ** 2 / 16 - ((p["k"] - 30) / 50) ** 2
    value += 0.2 * (p["kind"] == "b") - (0.02 * abs(p["deep"] - 5) if p["deep"] is not None else 0)
    return {"value": value}


def test_better_than_random_with_equal_seeds():
    gains = []
    for seed in range(12):
        best = [max(r["value"] for r in S.optimise(SPACE, planted, 60, seed, random_only=blind)) for blind in (False, True)]
        gains.append(best[0] - best[1])
    assert np.mean(gains) > 0.01 and sum(g > 0 for g in gains) >= 9


def test_ranges_and_conditions():
    rows = S.optimise(SPACE, planted, 40, 3)
    assert [r["trial"] for r in rows] == list(range(40))
    for p in (r["params"] for r in rows):
        assert 0 <= p["x"] <= 10 and 1e-4 <= p["rate"] <= 1 and 1 <= p["k"] <= 50 and isinstance(p["k"], int)
        assert (p["deep"] is None) == (p["kind"] != "b")
    boosted = [S.suggest(S.BOOST_SPACE, [], i) for i in range(200)]
    assert all(p["num_leaves"] <= 2 ** p["max_depth"] for p in boosted)
    trees = [S.suggest(S.EXTRA_TREES_SPACE, [], i) for i in range(200)]
    assert all((p["max_samples"] is None) == (not p["bootstrap"]) for p in trees)
    depths = {p["max_depth"] for p in trees if p["limit_depth"]}
    assert min(depths) <= 4 and max(depths) >= 39 and all((p["max_depth"] is None) != p["limit_depth"] for p in trees)


def test_goes_on_from_its_table():
    whole = S.optimise(SPACE, planted, 30, 5)
    for cut in (0, 4, 9, 18, 29):  # a broken batch is evaluated again
        asked = []
        again = S.optimise(SPACE, lambda p: (asked.append(p), planted(p))[1], 30, 5, before=whole[:cut], parallel=1)
        assert again == whole and len(asked) == 30 - cut + cut % S.BATCH


def test_trials_without_a_value_are_the_worst():
    rows = S.optimise(SPACE, lambda p: {"value": None if p["x"] < 5 else p["x"]}, 40, 1)
    late = [r["params"]["x"] for r in rows[20:]]
    assert sum(x > 5 for x in late) >= 17


def test_tunes_a_trainer_and_keeps_its_trials(spark, tmp_path):
    from candleflow.sources.store import TableStore

    rows = [("S", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i % 7), float(i % 3), int(i % 7 > 3) if i < 100 else 1)
            for i in range(130)]
    df = spark.createDataFrame(rows, "symbol string, ts date, x0 double, x1 double, target int")
    df = ML.assemble(df, ["x0", "x1"]).withColumn("weight", F.lit(1.0))
    space = {"n_estimators": S.Param(2, 5, whole=True), "max_depth": S.Param(1, 4, whole=True)}
    store = TableStore(spark, str(tmp_path / "store"))
    out = S.tune(df, "extra_trees", 2, space=space, batch=2, store=store)
    got = out.orderBy("trial").collect()
    assert len(got) == 2 and 0 < got[0]["n_folds"] < 5 and max(r["cv_roc_auc"] for r in got) > 0.8
    assert S.best_params(out)["n_estimators"] in (2, 3, 4, 5)
    more = S.tune(df, "extra_trees", 3, space=space, batch=2, store=store)
    assert sorted(map(tuple, more.collect()))[:2] == sorted(map(tuple, got))
    with pytest.raises(KeyError):
        S.tune(df, "nothing", 1)
