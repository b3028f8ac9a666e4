"""A large ensemble is scored where its subtrees are: the same probabilities,
with only the levels of the trees passing through the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleflow.operators import trees as T
from tests.test_trees import data, frame  # noqa: F401


@pytest.mark.parametrize("params, local_rows", [({}, 10_000), ({}, 40), ({"max_depth": 3}, 25),
                                                ({"min_samples_leaf": 6}, 0)])
def test_rows_meet_subtrees(spark, data, monkeypatch, params, local_rows, tmp_path):  # noqa: F811
    df = frame(spark, *data)
    model = T.fit_extra_trees(df, {"n_estimators": 7, **params}, local_rows=local_rows)
    expected = {(r["symbol"], r["ts"]): r["p"] for r in model.with_probability(df, out="p").collect()}
    model.save(str(tmp_path / "m"))
    monkeypatch.setattr(T, "SCORING_NODES", 5)
    monkeypatch.setattr(T, "TREES_AT_ONCE", 3)
    monkeypatch.setattr(T.TreeModel, "nodes", None)  # the whole trees are never collected
    scored = T.TreeModel.load(spark, str(tmp_path / "m")).with_probability(df.withColumn("kept", F.lit(1)), out="p")
    assert scored.columns == [*df.columns, "kept", "p"]
    rows = scored.collect()
    assert len(rows) == len(expected)
    for r in rows:
        assert r["p"] == pytest.approx(expected[r["symbol"], r["ts"]], abs=1e-12)
    assert model.with_probability(df.limit(0)).count() == 0


def test_a_tree_without_splits(spark, monkeypatch):
    rows = frame(spark, np.arange(12.0).reshape(6, 2), np.ones(6), np.ones(6))
    model = T.fit_extra_trees(rows, {"n_estimators": 2})
    monkeypatch.setattr(T, "SCORING_NODES", 1)
    assert [r["prob_up"] for r in model.with_probability(rows).collect()] == [1.0] * 6
