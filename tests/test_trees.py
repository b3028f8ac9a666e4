"""Extremely randomised trees: against a recursive tree written from the
definition, and the same trees however the nodes are dealt."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from candleflow.operators import trees as T

P = 6


def frame(spark, x, y, w):
    rows = [(f"S{i % 3}", dt.date(2020, 1, 1) + dt.timedelta(days=i), Vectors.dense(x[i]), float(y[i]), float(w[i]))
            for i in range(len(x))]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql import types as S
    schema = S.StructType([S.StructField("symbol", S.StringType()), S.StructField("ts", S.DateType()),
                           S.StructField("features", VectorUDT()), S.StructField("label", S.DoubleType()),
                           S.StructField("weight", S.DoubleType())])
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, P))
    x[:, 4] = 1.0  # constant
    x[:, 5] = np.round(x[:, 5])  # ties
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.5 * rng.standard_normal(400) > 0).astype(int)
    return x, y, rng.uniform(0.5, 2.0, 400)


def by_hand(x, y, w, node, depth, par):
    """(value, n) or (feature, threshold, left, right, gain) by recursion."""
    n, total, ones = len(x), w.sum(), (w * y).sum()

    def gini(mask):
        a, b = w[mask].sum(), (w * y)[mask].sum()
        return 2 * b * (a - b) / a if a else 0.0

    stop = n < max(par["min_samples_split"], 2 * par["min_samples_leaf"]) or ones in (0, total) or len(set(y)) < 2 \
        or (par["max_depth"] is not None and depth >= par["max_depth"])
    if not stop:
        lo, hi = x.min(0)[None], x.max(0)[None]
        features, thresholds = T.draw_candidates(np.array([node]), lo, hi, par["m"])
        best = None
        for f, t in zip(features[0], thresholds[0]):
            if f < 0:
                continue
            left = x[:, f] <= t
            if min(left.sum(), n - left.sum()) < par["min_samples_leaf"]:
                continue
            gain = gini(np.ones(n, bool)) - gini(left) - gini(~left)
            if best is None or gain > best[0] + T.TIE * total:
                best = (gain, int(f), float(t), left)
        if best:
            gain, f, t, left = best
            return (f, t, by_hand(x[left], y[left], w[left], T.child_id(node, 0), depth + 1, par),
                    by_hand(x[~left], y[~left], w[~left], T.child_id(node, 1), depth + 1, par), gain)
    return (ones / total, n)


def as_tree(nodes, at):
    if nodes.feature[at] < 0:
        return (nodes.value[at], nodes.n[at])
    return (nodes.feature[at], nodes.threshold[at], as_tree(nodes, nodes.left[at]), as_tree(nodes, nodes.right[at]),
            nodes.gain[at])


def same(a, b):
    assert len(a) == len(b)
    if len(a) == 2:
        assert abs(a[0] - b[0]) < 1e-9 and a[1] == b[1]
        return 1
    assert a[0] == b[0] and a[1] == b[1] and abs(a[4] - b[4]) < 1e-9
    return 1 + same(a[2], b[2]) + same(a[3], b[3])


@pytest.mark.parametrize("params, local_rows", [
    ({}, 10_000), ({}, 60), ({"max_depth": 4, "min_samples_leaf": 7, "min_samples_split": 30}, 25),
    ({"max_features": 1.0}, 0)])
def test_trees_rebuilt_by_hand(spark, data, params, local_rows):
    x, y, w = data
    model = T.fit_extra_trees(frame(spark, x, y, w), {"n_estimators": 3, **params}, local_rows=local_rows)
    nodes, par = model.nodes(), T._settled({"n_estimators": 3, **params}, P, 0)
    assert len(nodes.roots()) == 3
    for t, start in enumerate(nodes.roots().tolist()):
        same(as_tree(nodes, start), by_hand(x, y, w, T.root_id(42, t), 0, par))
    # every node is reached once from its root
    assert sorted(np.concatenate([nodes.left[nodes.left >= 0], nodes.right[nodes.right >= 0], nodes.roots()])) \
        == list(range(len(nodes)))


def test_probabilities_importances_and_storage(spark, data, tmp_path):
    x, y, w = data
    df = frame(spark, x, y, w)
    model = T.fit_extra_trees(df, {"n_estimators": 25, "min_samples_leaf": 5}, local_rows=100)
    nodes = model.nodes()
    expected = np.mean([nodes.value[T.descend(x, nodes, s)] for s in nodes.roots()], axis=0)
    order = {(f"S{i % 3}", dt.date(2020, 1, 1) + dt.timedelta(days=i)): i for i in range(len(x))}
    got = {order[r["symbol"], r["ts"]]: r["prob_up"] for r in model.with_probability(df).collect()}
    assert np.allclose([got[i] for i in range(len(x))], expected)
    imp = model.importances()
    assert abs(imp.sum() - 1) < 1e-12 and imp.argmax() == 0 and imp[4] == 0
    model.save(str(tmp_path / "m"))
    again = T.TreeModel.load(spark, str(tmp_path / "m"))
    assert again.with_probability(df).agg(F.sum("prob_up")).first()[0] == pytest.approx(expected.sum())


def test_scoring_in_several_passes(spark, data, monkeypatch):
    x, y, w = data
    df = frame(spark, x, y, w)
    model = T.fit_extra_trees(df, {"n_estimators": 6, "max_depth": 5})
    one = model.with_probability(df).agg(F.sum("prob_up")).first()[0]
    monkeypatch.setattr(T, "SCORING_NODES", 60)
    assert model.with_probability(df).agg(F.sum("prob_up")).first()[0] == pytest.approx(one)


def test_bootstrap_and_entropy(spark, data):
    x, y, w = data
    params = {"n_estimators": 4, "bootstrap": True, "max_samples": 0.7, "criterion": "entropy", "max_depth": 3}
    a = T.fit_extra_trees(frame(spark, x, y, w), params, local_rows=50).nodes()
    b = T.fit_extra_trees(frame(spark, x, y, w).repartition(5), params, local_rows=5000).nodes()
    assert [as_shape(a, s) for s in a.roots()] == [as_shape(b, s) for s in b.roots()]
    drawn = [a.n[s] for s in a.roots()]
    assert all(0.55 * len(x) < n < 0.85 * len(x) for n in drawn) and len(set(drawn)) > 1
    times = T.times_drawn(np.arange(100_000), 0, {"bootstrap": True, "max_samples": 1.0, "seed": 1})
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.03


def as_shape(nodes, at):
    if nodes.feature[at] < 0:
        return int(nodes.n[at])
    return (int(nodes.feature[at]), float(nodes.threshold[at]), as_shape(nodes, nodes.left[at]),
            as_shape(nodes, nodes.right[at]))


def test_no_split_and_bad_rows(spark):
    same_label = frame(spark, np.arange(12.0).reshape(6, 2), np.ones(6), np.ones(6))
    model = T.fit_extra_trees(same_label, {"n_estimators": 2})
    assert model.nodes().value.tolist() == [1.0, 1.0]
    with pytest.raises(ValueError):
        T.fit_extra_trees(same_label.limit(0))
    with pytest.raises(ValueError):
        T.fit_extra_trees(frame(spark, np.array([[1.0, float("nan")]]), [1], [1.0]))
