"""Leaf-wise gradient boosting (ML8) on gradient histograms.

Rows are binned once (quantile edges from one aggregate over all rows) and
kept as packed blocks of about ``BLOCK_ROWS`` rows, one byte a feature, next to
their running score.  A pass over the blocks adds up gradient, curvature and
count by (node, feature, bin) and hands on one small table a block; blocks
never meet.

A tree grows best leaf first: the leaf whose best split gains most is split
next, until ``num_leaves``.  One pass histograms the children of *all* leaves
that the order could still reach (only the smaller child of each; its sibling
is the parent less the child), then the order is replayed as far as it is
known.  Nodes of at most ``LOCAL_ROWS`` rows need no pass of their own levels:
their rows meet by node and each task group grows its subtree best leaf first,
as far as the whole tree could still need it.  The tree is the one that a pass
for every split would give, in as many passes as it has levels of larger nodes,
and one more.

Split gain and leaf values follow the usual second-order form with L1 and L2
penalties and smoothing towards the parent's value; rows and features are
sampled by hash for every round.  Missing features form the last bin and go
right.

The blocks are an RDD, since every round changes each row's score by a
per-block kernel that SQL cannot express; its lineage is cut by a reliable
checkpoint every ``CUT`` rounds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleflow.operators.trees import _NODE_SCHEMA, TreeModel, mix64
from candleflow.session import checkpoint_dir, materialize

BOOST_DEFAULTS = {"n_estimators": 500, "learning_rate": 0.03, "num_leaves": 31, "max_depth": -1,
                  "min_child_samples": 20, "min_child_weight": 1e-3, "min_gain_to_split": 0.01, "reg_alpha": 0.1,
                  "reg_lambda": 1.0, "path_smooth": 1.0, "subsample": 0.8, "colsample_bytree": 0.8, "max_bin": 127,
                  "seed": 42}
BLOCK_ROWS = 50_000
#: sampled rows of a node whose subtree one task group grows
LOCAL_ROWS = 50_000
CUT = 50


def bin_edges(rows: DataFrame, n_features: int, max_bin: int) -> list[np.ndarray]:
    """Upper edges of the bins of every feature: distinct quantiles."""
    probabilities = F.array(*[F.lit((i + 1) / max_bin) for i in range(max_bin)])
    exprs = []
    for f in range(n_features):
        v = F.get("x", F.lit(f))
        exprs.append(F.percentile_approx(F.when(~F.isnan(v), v), probabilities, F.lit(100 * max_bin)).alias(f"f{f}"))
    # groups of features: one aggregate holds a bounded number of sketches
    found = []
    for at in range(0, n_features, 64):
        found += list(rows.agg(*exprs[at:at + 64]).first())
    return [np.unique(np.array(q, np.float64)) if q else np.zeros(0) for q in found]


def _binned(x, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of raw values; what is above the last edge shares the last value
    bin, missing values have the bin after it."""
    out = np.empty(x.shape, np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), len(e), np.minimum(np.searchsorted(e, x[:, f]), max(len(e) - 1, 0)))
    return out


def _keep(ids, seed: int, round_: int, share: float) -> np.ndarray:
    """Bernoulli sample by hash."""
    if share >= 1.0:
        return np.ones(len(ids), bool)
    with np.errstate(over="ignore"):
        h = mix64(np.asarray(ids).astype(np.uint64) ^ mix64(np.uint64(seed * 1_000_003 + round_)))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53) < share


def chosen_features(n: int, seed: int, round_: int, share: float) -> np.ndarray:
    """``share`` of the features (one at least) of a round."""
    with np.errstate(over="ignore"):
        h = mix64(np.arange(n, dtype=np.uint64) ^ mix64(np.uint64(seed * 7_000_003 + round_)))
    return np.sort(np.argsort(h, kind="stable")[:max(1, int(share * n + 0.5))])


def _shrunk(g, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def leaf_value(g, h, n, parent, par: dict):
    """Newton step under L1 and L2, smoothed towards the parent's value."""
    value = -_shrunk(g, par["reg_alpha"]) / (h + par["reg_lambda"])
    if par["path_smooth"] > 0:
        trust = n / par["path_smooth"]
        value = (value * trust + parent) / (trust + 1)
    return value


def leaf_gain(g, h, value, par: dict):
    """What the loss gains from a leaf of this value."""
    return -(2 * _shrunk(g, par["reg_alpha"]) * value + (h + par["reg_lambda"]) * value * value)


class _Node:
    def __init__(self, hist, value: float, depth: int) -> None:
        self.hist, self.value, self.depth = hist, value, depth  # hist: features x bins x (g, h, n)
        self.split = None  # (gain, feature, bin, left value, right value)
        self.children: tuple | None = None
        first = hist[0].sum(0) if hist is not None and len(hist) else np.zeros(3)
        self.g, self.h, self.n = (float(v) for v in first)

    def find_split(self, features, n_bins, par: dict) -> None:
        """The best (feature, bin) by gain; of equal gains the first."""
        if par["max_depth"] > 0 and self.depth >= par["max_depth"] or self.n < 2 * par["min_child_samples"]:
            return
        total = np.array([self.g, self.h, self.n])
        left = np.cumsum(self.hist, axis=1)[:, :-1]
        right = total - left
        n_left, n_right = np.round(left[..., 2]), np.round(right[..., 2])
        a = leaf_value(left[..., 0], left[..., 1], n_left, self.value, par)
        b = leaf_value(right[..., 0], right[..., 1], n_right, self.value, par)
        own = leaf_gain(self.g, self.h, self.value, par)
        gain = leaf_gain(left[..., 0], left[..., 1], a, par) + leaf_gain(right[..., 0], right[..., 1], b, par) - own
        ok = (n_left >= par["min_child_samples"]) & (n_right >= par["min_child_samples"]) \
            & (left[..., 1] >= par["min_child_weight"]) & (right[..., 1] >= par["min_child_weight"]) \
            & (gain > par["min_gain_to_split"]) & (np.arange(left.shape[1])[None, :] < n_bins[features][:, None])
        if not ok.any():
            return
        gain = np.where(ok, gain, -np.inf)
        top = gain.max()
        f, t = np.unravel_index(int((gain >= top - 1e-10 * abs(top)).argmax()), gain.shape)
        self.split = (float(gain[f, t]), int(features[f]), int(t), float(a[f, t]), float(b[f, t]), int(f))


def _replay(root: _Node, num_leaves: int):
    """Best-first order as far as children are known: (split nodes in order,
    leaves whose children the next pass has to histogram)."""
    heap, order, count = [], [], 1

    def push(node):
        nonlocal count
        if node.split:
            heapq.heappush(heap, (-node.split[0], len(order), count, node))
            count += 1

    push(root)
    while heap and len(order) < num_leaves - 1:
        node = heap[0][3]
        if node.children is None:
            left = num_leaves - 1 - len(order)
            return order, [h[3] for h in heapq.nsmallest(left, heap) if h[3].children is None]
        heapq.heappop(heap)
        order.append(node)
        for c in node.children:
            push(c)
    return order, []


def _partial(root: _Node):
    """The tree expanded so far as arrays for the tasks: feature, bin, left,
    right, and the nodes by position."""
    nodes, at = [root], 0
    feature, cut, left, right = [], [], [], []
    while at < len(nodes):
        n = nodes[at]
        if n.children:
            feature.append(n.split[1])
            cut.append(n.split[2])
            left.append(len(nodes))
            right.append(len(nodes) + 1)
            nodes += list(n.children)
        else:
            feature.append(-1)
            cut.append(0)
            left.append(-1)
            right.append(-1)
        at += 1
    return tuple(np.array(c) for c in (feature, cut, left, right)), nodes


def _place(bins, arrays) -> np.ndarray:
    feature, cut, left, right = arrays
    at = np.zeros(len(bins), np.int64)
    moving = np.arange(len(bins)) if feature[0] >= 0 else np.zeros(0, np.int64)
    while len(moving):
        here = at[moving]
        goes = bins[moving, feature[here]] <= cut[here]
        at[moving] = np.where(goes, left[here], right[here])
        moving = moving[feature[at[moving]] >= 0]
    return at


def _histograms(blocks, wanted: int, node_of, features, width: int, seed: int, round_: int, share: float):
    """Sums by (wanted node, feature, bin): one array over all blocks.
    ``node_of(bins)`` gives each row's wanted node or -1."""
    def of_block(block):
        ids, bins, y, w, score = block
        p = 1 / (1 + np.exp(-score))
        at = node_of(bins)
        rows = np.flatnonzero((at >= 0) & _keep(ids, seed, round_, share))
        g, h = (w * (p - y))[rows], (w * p * (1 - p))[rows]
        out = np.empty((len(features), wanted * width, 3))
        for i, f in enumerate(features.tolist()):
            key = at[rows] * width + bins[rows, f]
            for c, v in enumerate((g, h, None)):
                out[i, :, c] = np.bincount(key, weights=v, minlength=wanted * width)
        return out

    parts = blocks.map(of_block)
    total = parts.treeReduce(np.add, 2) if blocks.getNumPartitions() > 32 else parts.reduce(np.add)
    return total.reshape(len(features), wanted, width, 3).transpose(1, 0, 2, 3)


def _subtree(bins, g, h, value, depth: int, splits: int, features, n_bins, width: int, par: dict) -> list[tuple]:
    """At most ``splits`` splits below a node from its rows, best leaf first:
    a row (value, sampled rows, split, position of the left child or -1) a
    node, the top first, the right child after the left.  A top without a
    value is the root of the tree."""
    cells = bins[:, features] + np.arange(len(features)) * width

    def sums(rows):
        at, out = cells[rows].ravel(), np.empty((len(features) * width, 3))
        for c, v in enumerate((g, h)):
            out[:, c] = np.bincount(at, weights=np.repeat(v[rows], len(features)), minlength=len(out))
        out[:, 2] = np.bincount(at, minlength=len(out))
        return out.reshape(len(features), width, 3)

    rows = np.arange(len(bins))
    top = _Node(sums(rows), value, depth)
    if value is None:
        top.value = root_value(top, par)
    top.find_split(features, n_bins, par)
    nodes, below, heap = [top], [-1], [(-top.split[0], 0, rows)] if top.split else []
    while heap and splits:
        _, i, rows = heapq.heappop(heap)
        splits -= 1
        n, below[i] = nodes[i], len(nodes)
        goes = bins[rows, n.split[1]] <= n.split[2]
        sides = rows[goes], rows[~goes]
        small = sums(min(sides, key=len))
        hists = (small, n.hist - small) if len(sides[0]) <= len(sides[1]) else (n.hist - small, small)
        n.hist = None
        for hist, v, here in zip(hists, n.split[3:5], sides):
            c = _Node(hist, v, n.depth + 1)
            c.find_split(features, n_bins, par)
            if c.split:
                heapq.heappush(heap, (-c.split[0], len(nodes), here))
            nodes.append(c)
            below.append(-1)
    return [(n.value, n.n, n.split, at) for n, at in zip(nodes, below)]


def _finish(blocks, tops: list[tuple], arrays, splits: int, features, n_bins, width: int, round_: int, par: dict):
    """Subtrees of small nodes, ``tops`` as (position in ``arrays``, value,
    depth): {position: rows of :func:`_subtree`}.  Rows meet by node; those of a
    single block are together as they are."""
    known = {at: (value, depth) for at, value, depth in tops}
    wanted = np.zeros(len(arrays[0]), bool)
    wanted[list(known)] = True

    def deal(block):
        ids, bins, y, w, score = block
        at = _place(bins, arrays)
        rows = np.flatnonzero(wanted[at] & _keep(ids, par["seed"], round_, par["subsample"]))
        p = 1 / (1 + np.exp(-score[rows]))
        g, h = w[rows] * (p - y[rows]), w[rows] * p * (1 - p)
        at = at[rows]
        for top in np.unique(at).tolist():
            here = at == top
            yield top, (bins[rows[here]], g[here], h[here])

    def grow(group):
        top, parts = group
        bins, g, h = (np.concatenate(c) for c in zip(*parts))
        return top, _subtree(bins, g, h, *known[top], splits, features, n_bins, width, par)

    dealt = blocks.flatMap(deal)
    parts = blocks.getNumPartitions()
    groups = dealt.groupByKey(min(parts, len(tops))) if parts > 1 else dealt.map(lambda kv: (kv[0], [kv[1]]))
    return dict(groups.map(grow).collect())


def _attach(top: _Node, rows: list[tuple]) -> None:
    """Hangs the nodes of :func:`_subtree` below ``top``."""
    nodes = {0: top}
    for i, (value, n, split, left) in enumerate(rows):  # parents come before children
        here = nodes[i]
        here.value, here.n, here.split, here.hist = value, n, split, None
        if left >= 0:
            here.children = tuple(_Node(None, 0.0, here.depth + 1) for _ in range(2))
            nodes[left], nodes[left + 1] = here.children


def root_value(root: _Node, par: dict) -> float:
    return float(leaf_value(root.g, root.h, root.n, 0.0, {**par, "path_smooth": 0}))


def _grow_tree(blocks, par: dict, n_features: int, n_bins, round_: int, n: int) -> tuple[_Node, list[_Node]]:
    """The root and its split nodes in order; ``n`` rows are in the blocks."""
    seed, share = par["seed"], par["subsample"]
    features = chosen_features(n_features, seed, round_, par["colsample_bytree"])
    width = int(n_bins.max()) + 1
    root, got = _Node(None, 0.0, 0), None
    if n <= LOCAL_ROWS:
        got = _finish(blocks, [(0, None, 0)], _partial(root)[0], par["num_leaves"] - 1, features, n_bins, width,
                      round_, par)
    if got:
        _attach(root, got[0])
    else:  # a large table, or no row was sampled
        whole = _histograms(blocks, 1, lambda bins: np.zeros(len(bins), np.int64), features, width, seed, round_,
                            share)
        root = _Node(whole[0], 0.0, 0)
        root.value = root_value(root, par)
        root.find_split(features, n_bins, par)
    while True:
        order, asked = _replay(root, par["num_leaves"])
        if not asked:
            return root, order
        arrays, nodes = _partial(root)
        large = [n for n in asked if n.n > LOCAL_ROWS]
        if not large:
            at = {id(n): i for i, n in enumerate(nodes)}
            tops = [(at[id(n)], n.value, n.depth) for n in asked]
            got = _finish(blocks, tops, arrays, par["num_leaves"] - 1 - len(order), features, n_bins, width, round_,
                          par)
            for i, rows in got.items():
                _attach(nodes[i], rows)
            continue
        asked = large
        position = {id(n): i for i, n in enumerate(nodes)}
        # the smaller child of each asked leaf, by its number of rows
        feature, cut = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
        slot, side = np.full(len(nodes), -1), np.zeros(len(nodes), bool)
        for k, n in enumerate(asked):
            i = position[id(n)]
            below = n.hist[n.split[5], :n.split[2] + 1, 2].sum()
            feature[i], cut[i], slot[i], side[i] = n.split[1], n.split[2], k, below > n.n - below

        def node_of(bins, arrays=arrays, feature=feature, cut=cut, slot=slot, side=side):
            at = _place(bins, arrays)
            k = slot[at]
            goes_right = bins[np.arange(len(bins)), np.maximum(feature[at], 0)] > cut[at]
            return np.where((k >= 0) & (goes_right == side[at]), k, -1)

        got = _histograms(blocks, len(asked), node_of, features, width, seed, round_, share)
        for k, n in enumerate(asked):
            small, large = got[k], n.hist - got[k]
            parts = (large, small) if side[position[id(n)]] else (small, large)
            n.children = tuple(_Node(h, v, n.depth + 1) for h, v in zip(parts, n.split[3:5]))
            for c in n.children:
                c.find_split(features, n_bins, par)


def _rows_of(root: _Node, order: list[_Node], tree: int, edges, rate: float):
    """Node table rows of a finished tree, and its arrays for the tasks."""
    split = {id(n) for n in order}
    nodes, at, table = [root], 0, []
    while at < len(nodes):
        n = nodes[at]
        if id(n) in split:
            table.append((tree, at, n.split[1], float(edges[n.split[1]][n.split[2]]), len(nodes), len(nodes) + 1,
                          n.value * rate, n.split[0], int(round(n.n))))
            nodes += list(n.children)
        else:
            table.append((tree, at, -1, 0.0, -1, -1, n.value * rate, 0.0, int(round(n.n))))
        at += 1
    arrays = tuple(np.array([r[c] for r in table]) for c in (2, 4, 5))
    cut = np.array([nodes[i].split[2] if r[2] >= 0 else 0 for i, r in enumerate(table)])
    return table, (arrays[0], cut, arrays[1], arrays[2]), np.array([r[6] for r in table])


def fit_boosted(train: DataFrame, params: dict | None = None, features: str = "features",
                key=("symbol", "ts")) -> TreeModel:
    """ML8: ``train`` has ``features`` (vector), ``label`` (0/1) and, if any,
    ``weight``.  Parameters as in ``BOOST_DEFAULTS``.  Of the driver's memory it
    takes the trees and a histogram for each open leaf."""
    spark = train.sparkSession
    par = {**BOOST_DEFAULTS, **(params or {})}
    named = [c for c in key if c in train.columns]
    rid = F.xxhash64(*named) if named else F.monotonically_increasing_id()
    weight = F.col("weight").cast("double") if "weight" in train.columns else F.lit(1.0)
    rows = materialize(train.select(
        rid.alias("rid"), F.transform(vector_to_array(features), lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x"),
        F.col("label").cast("double").alias("y"), weight.alias("w")), "boost_rows")
    n, total, ones, p = rows.agg(F.count("*"), F.sum("w"), F.sum(F.col("w") * F.col("y")), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("no training rows")
    edges = bin_edges(rows, p, par["max_bin"])
    n_bins = np.array([max(1, len(e)) for e in edges])  # without the bin of missing values
    mean = min(max(ones / total, 1e-9), 1 - 1e-9)
    start = math.log(mean / (1 - mean))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, p)
            cells = [b.column("rid").to_numpy().astype("<i8").tobytes(), _binned(x, edges).tobytes(),
                     b.column("y").to_numpy().astype("<f8").tobytes(), b.column("w").to_numpy().astype("<f8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], ["rid", "bins", "y", "w"])

    packed = rows.repartition(max(1, -(-n // BLOCK_ROWS)), "rid").mapInArrow(
        pack, "rid binary, bins binary, y binary, w binary")

    def unpack(part):
        got = [(np.frombuffer(r["rid"], "<i8"), np.frombuffer(r["bins"], np.uint8).reshape(-1, p),
                np.frombuffer(r["y"], "<f8"), np.frombuffer(r["w"], "<f8")) for r in part]
        if got:
            ids, bins, y, w = (np.concatenate(c) for c in zip(*got))
            yield ids, bins, y, w, np.full(len(y), start)

    checkpoint_dir(spark)
    blocks = materialize(packed, "boost_blocks").rdd.mapPartitions(unpack).persist(StorageLevel.MEMORY_AND_DISK)
    table, before = [], None
    for round_ in range(par["n_estimators"]):
        root, order = _grow_tree(blocks, par, p, n_bins, round_, n)  # its first pass works the new scores out
        if before is not None:
            before.unpersist()
        rows_, arrays, values = _rows_of(root, order, round_, edges, par["learning_rate"])
        table += rows_

        def scored(block, arrays=arrays, values=values):
            ids, bins, y, w, score = block
            return ids, bins, y, w, score + values[_place(bins, arrays)]

        before, blocks = blocks, blocks.map(scored).persist(StorageLevel.MEMORY_AND_DISK)
        if round_ % CUT == CUT - 1:
            blocks.checkpoint()
    if before is not None:
        before.unpersist()
    nodes = materialize(spark.createDataFrame(table, _NODE_SCHEMA), "boosted")
    return TreeModel(nodes, par["n_estimators"], p, "logit", start)
