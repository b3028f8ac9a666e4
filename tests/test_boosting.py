"""Leaf-wise boosting against a plain best-first booster that works every split
out from the rows themselves."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleflow.operators import boosting as B
from candleflow.operators import trees as T
from tests.test_trees import as_tree, frame

PAR = {"n_estimators": 3, "num_leaves": 9, "learning_rate": 0.2, "min_child_samples": 5, "subsample": 0.9,
       "max_bin": 31}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((200, 5))
    x[:, 3] = np.round(2 * x[:, 3])
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.standard_normal(200) > 0).astype(int)
    return x, y, rng.uniform(0.5, 2.0, 200)


def by_hand(x, y, w, ids, edges, par):
    """Trees as nested tuples, and the final scores."""
    score = np.full(len(y), math.log((w @ y) / w.sum() / (1 - (w @ y) / w.sum())))
    start, trees = score[0], []
    for r in range(par["n_estimators"]):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (p - y), w * p * (1 - p)
        bag = B._keep(ids, par["seed"], r, par["subsample"])
        features = B.chosen_features(x.shape[1], par["seed"], r, par["colsample_bytree"])

        def best(mask, value, depth, g=g, h=h, bag=bag, features=features):
            rows, top = mask & bag, None
            if 0 < par["max_depth"] <= depth:
                return None
            own = B.leaf_gain(g[rows].sum(), h[rows].sum(), value, par)
            for f in features:
                for t in edges[f][:-1]:
                    left, right = rows & (x[:, f] <= t), rows & ~(x[:, f] <= t)
                    if min(left.sum(), right.sum()) < par["min_child_samples"]:
                        continue
                    v = [float(B.leaf_value(g[m].sum(), h[m].sum(), m.sum(), value, par)) for m in (left, right)]
                    gain = sum(B.leaf_gain(g[m].sum(), h[m].sum(), u, par) for m, u in zip((left, right), v)) - own
                    if gain > par["min_gain_to_split"] and (top is None or gain > top[0] * (1 + 1e-10)):
                        top = (gain, f, t, *v)
            return top

        everyone = np.ones(len(y), bool)
        rows = everyone & bag
        value = float(B.leaf_value(g[rows].sum(), h[rows].sum(), rows.sum(), 0.0, {**par, "path_smooth": 0}))
        root = {"mask": everyone, "value": value, "split": best(everyone, value, 0), "depth": 0}
        leaves = [root]
        while len(leaves) < par["num_leaves"] and any(n["split"] for n in leaves):
            n = max((n for n in leaves if n["split"]), key=lambda n: n["split"][0])
            gain, f, t, a, b = n["split"]
            leaves = [o for o in leaves if o is not n]
            n["kids"] = []
            for v, m in ((a, n["mask"] & (x[:, f] <= t)), (b, n["mask"] & ~(x[:, f] <= t))):
                n["kids"].append({"mask": m, "value": v, "split": best(m, v, n["depth"] + 1), "depth": n["depth"] + 1})
            leaves += n["kids"]
        for n in leaves:
            score = score + n["mask"] * n["value"] * par["learning_rate"]

        def nested(n, bag=bag):
            if "kids" not in n:
                return (n["value"] * par["learning_rate"], int((n["mask"] & bag).sum()))
            return (n["split"][1], n["split"][2], *map(nested, n["kids"]), n["split"][0])

        trees.append(nested(root))
    return trees, score, start


def same(a, b):
    assert len(a) == len(b)
    if len(a) == 2:
        assert a[0] == pytest.approx(b[0], abs=1e-9) and a[1] == b[1]
    else:
        assert a[0] == b[0] and a[1] == b[1] and a[4] == pytest.approx(b[4], rel=1e-7)
        same(a[2], b[2])
        same(a[3], b[3])


@pytest.mark.parametrize("more, block_rows", [({}, 50_000), ({"max_depth": 3, "path_smooth": 0.0}, 60),
                                              ({"colsample_bytree": 0.5, "reg_alpha": 2.0}, 90)])
def test_trees_as_by_hand(spark, data, monkeypatch, more, block_rows):
    monkeypatch.setattr(B, "BLOCK_ROWS", block_rows)
    x, y, w = data
    df = frame(spark, x, y, w)
    par = {**B.BOOST_DEFAULTS, **PAR, **more}
    model = B.fit_boosted(df, par)
    rows = df.select("symbol", "ts", F.xxhash64("symbol", "ts").alias("rid")).collect()
    ids = {(r["symbol"], r["ts"]): r["rid"] for r in rows}
    import datetime as dt
    order = [(f"S{i % 3}", dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(len(x))]
    written = df.select(F.lit(0).alias("rid"), T.vector_to_array("features").alias("x"))
    edges = B.bin_edges(written, x.shape[1], par["max_bin"])
    trees, score, start = by_hand(x, y, w, np.array([ids[k] for k in order]), edges, par)
    nodes = model.nodes()
    assert model.start == pytest.approx(start)
    for mine, root in zip(trees, nodes.roots().tolist()):
        same(as_tree(nodes, root), mine)
    got = {(r["symbol"], r["ts"]): r["prob_up"] for r in model.with_probability(df).collect()}
    assert np.allclose([got[k] for k in order], 1 / (1 + np.exp(-score)))


def test_learns_an_interaction_and_keeps_through_checkpoints(spark, data, monkeypatch):
    monkeypatch.setattr(B, "CUT", 4)
    x, y, w = data
    df = frame(spark, x, y, w)
    model = B.fit_boosted(df, {"n_estimators": 30, "learning_rate": 0.3, "min_child_samples": 8})
    hit = model.with_probability(df).agg(F.avg((F.round("prob_up") == F.col("label")).cast("int"))).first()[0]
    assert hit > 0.9
    imp = model.importances()
    assert imp[0] + imp[1] > imp[2:].sum()


def test_missing_values_constant_features_and_one_label(spark):
    x = np.array([[float("nan") if i % 2 else 1.0 * i, 7.0] for i in range(80)])
    y = np.arange(80) % 2
    df = frame(spark, x, y, np.ones(80))
    model = B.fit_boosted(df, {"n_estimators": 5, "subsample": 1.0, "colsample_bytree": 1.0, "learning_rate": 0.5})
    p = [(r["label"], r["prob_up"]) for r in model.with_probability(df).collect()]
    assert min(v for k, v in p if k == 1) > max(v for k, v in p if k == 0)
    flat = B.fit_boosted(frame(spark, x, np.zeros(80), np.ones(80)), {"n_estimators": 2})
    assert max(r["prob_up"] for r in flat.with_probability(df).collect()) < 1e-6
