"""Boosted trees are the same wherever their nodes are split, and a table whose
rows one task group may hold costs one pass a round."""

import numpy as np
import pytest

from candleflow.operators import boosting as B
from tests.test_boosting import PAR, data, same  # noqa: F401
from tests.test_trees import as_tree, frame


def fitted(spark, data, **more):  # noqa: F811
    model = B.fit_boosted(frame(spark, *data), {**PAR, **more})
    nodes = model.nodes()
    return [as_tree(nodes, r) for r in nodes.roots().tolist()]


@pytest.mark.parametrize("local_rows, block_rows", [(0, 50_000), (45, 50_000), (45, 60), (10_000, 60)])
@pytest.mark.parametrize("more", [{}, {"max_depth": 3, "num_leaves": 31}])
def test_same_trees_wherever_nodes_are_split(spark, data, monkeypatch, local_rows, block_rows, more):  # noqa: F811
    whole = fitted(spark, data, **more)
    monkeypatch.setattr(B, "LOCAL_ROWS", local_rows)
    monkeypatch.setattr(B, "BLOCK_ROWS", block_rows)
    for a, b in zip(whole, fitted(spark, data, **more), strict=True):
        same(a, b)


def test_one_pass_a_round(spark, data):  # noqa: F811
    sc = spark.sparkContext

    def jobs(rounds):
        sc.setJobGroup(f"boost-{rounds}", "boost")
        fitted(spark, data, n_estimators=rounds)
        return len(sc.statusTracker().getJobIdsForGroup(f"boost-{rounds}"))

    assert jobs(12) - jobs(2) == 10


def test_a_round_without_sampled_rows(spark):
    x = np.arange(6.0)[:, None]
    model = B.fit_boosted(frame(spark, x, np.arange(6) % 2, np.ones(6)), {"n_estimators": 3, "subsample": 1e-9})
    assert list(model.nodes().n) == [0, 0, 0]
