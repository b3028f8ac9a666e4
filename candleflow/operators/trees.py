"""Extremely randomised trees (ML7) grown by Spark, and the node tables that
all tree models of this package are kept in.

Every node has a 64-bit id: the root's is a hash of the seed and the tree, a
child's a hash of its parent's and the side.  The candidate features of a node
and the random threshold of each (uniform between the smallest and the largest
value in the node) are hashes of that id, so a tree does not depend on how its
rows are dealt to tasks, nor on where a node is split.

Large nodes
    All trees grow level by level.  One pass tells the count, class weights
    and value range of every (node, feature), a second one counts
    the sides of every (node, candidate, threshold); both are grouped sums over
    per-task partial tables.  Rows find their node by descending the levels
    grown so far, which travel as one table (a node of it stands for more than
    ``LOCAL_ROWS`` rows of a tree, which bounds it).
Small nodes
    A node of at most ``LOCAL_ROWS`` rows is gathered by (tree, node) and its
    whole subtree is grown in that task group; no group is larger than that.

Semantics: weighted gini or entropy; features that are constant in a node are
passed over when its candidates are drawn; a split leaves ``min_leaf`` rows or
more on each side; of equal gains the first candidate drawn wins.  Bootstrap
draws every row a Poisson number of times by a hash of its id and the tree.
Rows with a missing feature are refused (the feature table has none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candleflow.session import materialize

LOCAL_ROWS = 4_000
#: trees grown at once: bounds the level tables and the rows sent to groups
TREES_AT_ONCE = 100
#: nodes that travel through the driver to the tasks when rows are scored; a
#: larger ensemble stays where it is, and the rows go to its subtrees
SCORING_NODES = 200_000

#: gains closer than this share of the node's weight are equal
TIE = 1e-10

EXTRA_TREES_DEFAULTS = {"n_estimators": 300, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1,
                        "max_features": "sqrt", "criterion": "gini", "bootstrap": False, "max_samples": None,
                        "seed": 42}

_NODE_SCHEMA = ("tree int, node int, feature int, threshold double, left int, right int, value double, "
                "gain double, n long")


def mix64(x):
    """The splitmix64 finaliser on arrays of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def child_id(node, side: int):
    with np.errstate(over="ignore"):
        return mix64(np.asarray(node, np.uint64) * np.uint64(2) + np.uint64(side + 1))


def root_id(seed: int, tree: int):
    return mix64(np.uint64(seed * 1_000_003 + tree))


def _draws(node, n_features: int, salt: int):
    """One 64-bit draw for every (node, feature)."""
    with np.errstate(over="ignore"):
        of = mix64(np.arange(n_features, dtype=np.uint64) + np.uint64(salt * 1_000_003))
        return mix64(np.asarray(node, np.uint64)[:, None] ^ of[None, :])


def draw_candidates(node, lo, hi, m: int):
    """For nodes with value ranges ``lo``/``hi`` (nodes x features): up to
    ``m`` features that are not constant, in drawn order (-1: none left), and
    their thresholds."""
    k, p = lo.shape
    order = _draws(node, p, 1)
    order[~(lo < hi)] = np.uint64(0xFFFFFFFFFFFFFFFF)
    features = np.argsort(order, axis=1, kind="stable")[:, :m]
    at = np.arange(k)[:, None]
    u = (_draws(node, p, 2)[at, features] >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    low, high = lo[at, features], hi[at, features]
    threshold = low + u * (high - low)
    threshold = np.where(threshold >= high, low, threshold)
    return np.where(low < high, features, -1), threshold


def impurity(w1, w, criterion: str):
    """Weighted impurity times weight: comparable sums over nodes."""
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.where(w > 0, w1 / w, 0.0)
        if criterion == "gini":
            return w * 2 * q * (1 - q)
        log = np.where(q > 0, q * np.log2(q), 0.0) + np.where(q < 1, (1 - q) * np.log2(1 - q), 0.0)
        return -w * log


def best_splits(totals, left, criterion: str, min_leaf: int):
    """``totals`` (nodes x 3) and ``left`` (nodes x candidates x 3) hold rows,
    weight and weight of label 1 -> (candidate or -1, gain) per node."""
    n, w, w1 = (totals[:, None, i] for i in range(3))
    ln, lw, lw1 = (left[:, :, i] for i in range(3))
    gain = impurity(w1, w, criterion) - impurity(lw1, lw, criterion) - impurity(w1 - lw1, w - lw, criterion)
    gain = np.where((ln >= min_leaf) & (n - ln >= min_leaf), gain, -np.inf)
    # gains that differ by rounding only are equal: the first drawn wins
    best = (gain >= gain.max(1, keepdims=True) - TIE * w).argmax(1)
    top = gain[np.arange(len(gain)), best]
    return np.where(np.isfinite(top), best, -1), top


def may_split(totals, depth: int, max_depth, min_split: int, min_leaf: int):
    """Nodes with rows enough, both labels, and depth left."""
    n, w, w1 = totals[:, 0], totals[:, 1], totals[:, 2]
    deep = max_depth is not None and depth >= max_depth
    pure = (w1 <= 0) | (w1 >= w * (1 - 1e-15))
    return (n >= max(min_split, 2 * min_leaf)) & ~pure & (not deep)


@dataclass
class Nodes:
    """Nodes of one or more trees as columns; ``left`` / ``right`` are
    positions in the same columns, ``feature`` is -1 for a leaf."""

    tree: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    n: np.ndarray

    def __len__(self) -> int:
        return len(self.tree)

    def roots(self):
        return np.flatnonzero(self.node == 0)


def grow(x, y, w, times, root, depth: int, params: dict):
    """One subtree from its rows: columns (feature, threshold, left, right,
    value, gain, n), the subtree's root first, children as positions."""
    m, criterion = params["m"], params["criterion"]
    min_split, min_leaf, max_depth = params["min_samples_split"], params["min_samples_leaf"], params["max_depth"]
    rows = np.flatnonzero(times > 0)
    stats = np.stack([times, times * w, times * w * y], axis=1).astype(np.float64)
    out = {k: [] for k in ("feature", "threshold", "left", "right", "value", "gain", "n")}
    ids, starts, made = np.array([root], np.uint64), np.zeros(1, np.int64), 0
    while len(ids):
        s = stats[rows]
        totals = np.add.reduceat(s, starts, axis=0)
        sizes = np.diff(np.append(starts, len(rows)))
        k = len(ids)
        feature, threshold = np.full(k, -1), np.zeros(k)
        gain, chosen = np.zeros(k), np.zeros(k, bool)
        split = np.flatnonzero(may_split(totals, depth, max_depth, min_split, min_leaf))
        if len(split):
            # only the rows of nodes that may be split go on
            keep = np.repeat(np.isin(np.arange(k), split), sizes)
            rows, s = rows[keep], s[keep]
            at = np.repeat(np.arange(len(split)), sizes[split])
            first = np.concatenate(([0], np.cumsum(sizes[split])[:-1]))
            xs = x[rows]
            candidates, t = draw_candidates(ids[split], np.minimum.reduceat(xs, first, axis=0),
                                            np.maximum.reduceat(xs, first, axis=0), m)
            left = np.zeros((len(split), candidates.shape[1], 3))
            lane = np.arange(len(rows))
            for j in range(candidates.shape[1]):
                goes = (xs[lane, candidates[at, j]] <= t[at, j]) & (candidates[at, j] >= 0)
                left[:, j] = np.add.reduceat(s * goes[:, None], first, axis=0)
            best, top = best_splits(totals[split], left, criterion, min_leaf)
            ok = best >= 0
            feature[split[ok]] = candidates[ok, best[ok]]
            threshold[split[ok]] = t[ok, best[ok]]
            gain[split[ok]], chosen[split[ok]] = top[ok], True
        n_split = int(chosen.sum())
        below = made + k + 2 * np.cumsum(chosen) - 2
        out["feature"].append(feature)
        out["threshold"].append(threshold)
        out["left"].append(np.where(chosen, below, -1))
        out["right"].append(np.where(chosen, below + 1, -1))
        out["value"].append(np.divide(totals[:, 2], totals[:, 1], out=np.zeros(k), where=totals[:, 1] > 0))
        out["gain"].append(gain)
        out["n"].append(totals[:, 0].astype(np.int64))
        made += k
        if not n_split:
            break
        kept = ok[at]
        rows, at, xs = rows[kept], at[kept], xs[kept]
        rank = np.cumsum(ok) - 1  # of the nodes that were split
        node = split[at]
        right = xs[np.arange(len(rows)), feature[node]] > threshold[node]
        place = 2 * rank[at] + right
        order = np.argsort(place, kind="stable")
        rows = rows[order]
        starts = np.searchsorted(place[order], np.arange(2 * n_split))
        parents = ids[chosen]
        ids = np.stack([child_id(parents, 0), child_id(parents, 1)], axis=1).ravel()
        depth += 1
    return {key: np.concatenate(v) for key, v in out.items()}


def times_drawn(rid, tree: int, params: dict):
    """How often each row is drawn for a tree: once, or Poisson by hash."""
    if not params["bootstrap"]:
        return np.ones(len(rid))
    rate = params["max_samples"] or 1.0
    with np.errstate(over="ignore"):
        h = mix64(np.asarray(rid).astype(np.uint64) ^ root_id(params["seed"] + 17, tree))
    u = (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    times, p, below = np.zeros(len(u)), math.exp(-rate), np.zeros(len(u))
    cumulative = p
    for k in range(1, 20):
        times += u >= cumulative
        p *= rate / k
        cumulative += p
    return times


def descend(x, nodes: Nodes, start: int):
    """Position of the node every row of ``x`` ends in, from ``start``."""
    at = np.full(len(x), start)
    moving = np.flatnonzero(nodes.feature[at] >= 0)
    while len(moving):
        here = at[moving]
        goes_left = x[moving, nodes.feature[here]] <= nodes.threshold[here]
        at[moving] = np.where(goes_left, nodes.left[here], nodes.right[here])
        moving = moving[nodes.feature[at[moving]] >= 0]
    return at


def training_rows(df: DataFrame, features: str = "features", key=("symbol", "ts")) -> DataFrame:
    """``rid``, ``x``, ``y``, ``w`` of assembled rows, written once."""
    named = [c for c in key if c in df.columns]
    rid = F.xxhash64(*named) if named else F.monotonically_increasing_id()
    rows = df.select(rid.alias("rid"), vector_to_array(features).alias("x"), F.col("label").cast("double").alias("y"),
                     (F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)).alias("w"))
    rows = materialize(rows, "training_rows")
    if rows.where(F.exists("x", lambda v: v.isNull() | F.isnan(v)) | F.col("y").isNull()).limit(1).count():
        raise ValueError("a training row has a missing feature or label")
    return rows


def _arrays(batch: pa.RecordBatch):
    column = batch.column("x")
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return batch.column("rid").to_numpy(), x, batch.column("y").to_numpy(), batch.column("w").to_numpy()


class _Level:
    """The levels of a group of trees grown so far, on the driver: a row per
    node that stood for more than ``LOCAL_ROWS`` rows, and their children."""

    def __init__(self, trees: range, seed: int) -> None:
        k = len(trees)
        self.trees = list(trees)
        self.tree, self.id = list(trees), [root_id(seed, t) for t in trees]
        self.depth = [0] * k
        self.feature, self.threshold = [-1] * k, [0.0] * k
        self.left, self.right = [-1] * k, [-1] * k
        self.value, self.gain, self.n = [0.0] * k, [0.0] * k, [0] * k
        self.done = [False] * k  # a leaf for good

    def split(self, i: int, feature: int, threshold: float, gain: float) -> list[int]:
        at = len(self.tree)
        self.feature[i], self.threshold[i], self.gain[i] = feature, threshold, gain
        self.left[i], self.right[i] = at, at + 1
        for side in (0, 1):
            self.tree.append(self.tree[i])
            self.id.append(child_id(self.id[i], side))
            self.depth.append(self.depth[i] + 1)
            for column, blank in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1),
                                  (self.value, 0.0), (self.gain, 0.0), (self.n, 0), (self.done, False)):
                column.append(blank)
        return [at, at + 1]

    def nodes(self) -> Nodes:
        size = len(self.tree)
        return Nodes(np.array(self.tree), np.arange(size), np.array(self.feature), np.array(self.threshold),
                     np.array(self.left), np.array(self.right), np.array(self.value), np.array(self.gain),
                     np.array(self.n, np.int64))


def _table_sums(rows: DataFrame, work, schema: str, keys: list[str], aggregates: list[Column]):
    return rows.mapInArrow(work, schema).groupBy(*keys).agg(*aggregates).toArrow()


def _grow_group(rows: DataFrame, trees: range, n_features: int, params: dict) -> DataFrame:
    """Nodes of some trees as a written table (``_NODE_SCHEMA`` with tree-wide
    node numbers)."""
    spark = rows.sparkSession
    level = _Level(trees, params["seed"])
    limits = (params["max_depth"], params["min_samples_split"], params["min_samples_leaf"])
    roots = {t: i for i, t in enumerate(level.trees)}
    open_nodes = list(range(len(level.trees)))
    p = n_features
    while open_nodes:
        nodes, open_set = level.nodes(), np.array(sorted(open_nodes))
        shared = spark.sparkContext.broadcast((nodes, open_set, roots, params))

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, wanted, first, par = shared.value
            k = len(wanted)
            sums = np.zeros((k, 3))
            lo, hi = np.full((k, p), np.inf), np.full((k, p), -np.inf)
            for batch in batches:
                rid, x, y, w = _arrays(batch)
                if not len(x):
                    continue
                for t, start in first.items():
                    times = times_drawn(rid, t, par)
                    at = np.searchsorted(wanted, end := descend(x, table, start))
                    at = np.where(at < k, at, 0)
                    here = np.flatnonzero((wanted[at] == end) & (times > 0))
                    if not len(here):
                        continue
                    here = here[np.argsort(at[here], kind="stable")]
                    slots, begin = np.unique(at[here], return_index=True)
                    tw = times[here]
                    s = np.stack([tw, tw * w[here], tw * w[here] * y[here]], axis=1)
                    sums[slots] += np.add.reduceat(s, begin, axis=0)
                    lo[slots] = np.minimum(lo[slots], np.minimum.reduceat(x[here], begin, axis=0))
                    hi[slots] = np.maximum(hi[slots], np.maximum.reduceat(x[here], begin, axis=0))
            seen = np.flatnonzero(sums[:, 0] > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(seen, p)), pa.array(np.tile(np.arange(p), len(seen))),
                 *[pa.array(np.repeat(sums[seen, i], p)) for i in range(3)],
                 pa.array(lo[seen].ravel()), pa.array(hi[seen].ravel())], ["i", "f", "n", "w", "w1", "lo", "hi"])

        got = _table_sums(rows, ranges, "i long, f long, n double, w double, w1 double, lo double, hi double",
                          ["i", "f"], [F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("w1").alias("w1"),
                                       F.min("lo").alias("lo"), F.max("hi").alias("hi")])
        k = len(open_set)
        totals, lo, hi = np.zeros((k, 3)), np.zeros((k, p)), np.zeros((k, p))
        i, f = got["i"].to_numpy(), got["f"].to_numpy()
        lo[i, f], hi[i, f] = got["lo"].to_numpy(), got["hi"].to_numpy()
        for c, name in enumerate(("n", "w", "w1")):
            totals[i, c] = got[name].to_numpy()
        for j, node in enumerate(open_set.tolist()):
            level.n[node] = int(totals[j, 0])
            level.value[node] = float(totals[j, 2] / totals[j, 1]) if totals[j, 1] > 0 else 0.0
        depths = np.array([level.depth[v] for v in open_set])
        can = np.array([bool(may_split(totals[j:j + 1], int(depths[j]), *limits)[0]) for j in range(k)])
        for j in np.flatnonzero(~can):
            level.done[int(open_set[j])] = True
        big = np.flatnonzero(can & (totals[:, 0] > params["local_rows"]))
        open_nodes = []
        if len(big):
            ids = np.array([level.id[v] for v in open_set[big]], np.uint64)
            candidates, thresholds = draw_candidates(ids, lo[big], hi[big], params["m"])
            asked = spark.sparkContext.broadcast((nodes, open_set[big], candidates, thresholds, roots, params))

            def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                table, wanted, cand, thr, first, par = asked.value
                kk, m = cand.shape
                left = np.zeros((kk, m, 3))
                for batch in batches:
                    rid, x, y, w = _arrays(batch)
                    if not len(x):
                        continue
                    for t, start in first.items():
                        times = times_drawn(rid, t, par)
                        at = np.searchsorted(wanted, end := descend(x, table, start))
                        at = np.where(at < kk, at, 0)
                        here = np.flatnonzero((wanted[at] == end) & (times > 0))
                        if not len(here):
                            continue
                        slot, tw = at[here], times[here]
                        for j in range(m):
                            goes = (x[here, cand[slot, j]] <= thr[slot, j]) & (cand[slot, j] >= 0)
                            for c, v in enumerate((tw, tw * w[here], tw * w[here] * y[here])):
                                left[:, j, c] += np.bincount(slot, weights=v * goes, minlength=kk)
                cells = np.arange(kk * m)
                flat = left.reshape(-1, 3)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells), *[pa.array(flat[:, c]) for c in range(3)]], ["i", "n", "w", "w1"])

            got = _table_sums(rows, sides, "i long, n double, w double, w1 double", ["i"],
                              [F.sum(c).alias(c) for c in ("n", "w", "w1")])
            left = np.zeros((candidates.size, 3))
            for c, name in enumerate(("n", "w", "w1")):
                left[got["i"].to_numpy(), c] = got[name].to_numpy()
            best, gain = best_splits(totals[big], left.reshape(*candidates.shape, 3), params["criterion"],
                                     params["min_samples_leaf"])
            for j, b in enumerate(best.tolist()):
                node = int(open_set[big[j]])
                if b < 0:
                    level.done[node] = True
                else:
                    open_nodes += level.split(node, int(candidates[j, b]), float(thresholds[j, b]), float(gain[j]))
            asked.unpersist()
        shared.unpersist()

    nodes = level.nodes()
    small = np.flatnonzero((nodes.feature < 0) & ~np.array(level.done))
    grown = _grow_small(rows, nodes, small, level, params)
    # number the nodes of each tree: the levels first, then every subtree
    return _stitch(spark, nodes, small, grown)


def _grow_small(rows: DataFrame, nodes: Nodes, small, level: _Level, params: dict) -> DataFrame:
    """Subtrees of the small nodes: rows meet by (tree, node), packed."""
    spark = rows.sparkSession
    roots = {t: i for i, t in enumerate(level.trees)}
    ids = {int(v): (int(level.id[v]), level.depth[v]) for v in small}
    shared = spark.sparkContext.broadcast((nodes, small, roots, ids, params))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, wanted, first, _, par = shared.value
        for batch in batches:
            rid, x, y, w = _arrays(batch)
            for t, start in first.items():
                times = times_drawn(rid, t, par)
                end = descend(x, table, start) if len(x) else np.zeros(0, np.int64)
                here = np.flatnonzero(np.isin(end, wanted) & (times > 0))
                here = here[np.argsort(end[here], kind="stable")]
                at, begin = np.unique(end[here], return_index=True)
                stops = np.append(begin[1:], len(here))
                packed = [np.ascontiguousarray(np.column_stack(
                    [times[here[a:b]], w[here[a:b]], y[here[a:b]], x[here[a:b]]]), "<f8").tobytes()
                    for a, b in zip(begin, stops)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(packed, pa.binary())],
                    ["tree", "top", "rows"])

    def finish(group: pa.Table) -> pa.Table:
        _, _, _, known, par = shared.value
        tree, top = group["tree"][0].as_py(), group["top"][0].as_py()
        width = par["n_features"] + 3
        # the order of the rows does not matter to the tree, but to rounding
        block = np.concatenate([np.frombuffer(b, "<f8").reshape(-1, width) for b in group["rows"].to_pylist()])
        node, depth = known[top]
        sub = grow(block[:, 3:], block[:, 2], block[:, 1], block[:, 0], np.uint64(node), depth, par)
        k = len(sub["feature"])
        return pa.table({"tree": pa.array([tree] * k, pa.int32()), "top": pa.array([top] * k, pa.int32()),
                         "sub": pa.array(np.arange(k), pa.int32()), **{
            c: pa.array(sub[c], kind) for c, kind in (
                ("feature", pa.int32()), ("threshold", pa.float64()), ("left", pa.int32()), ("right", pa.int32()),
                ("value", pa.float64()), ("gain", pa.float64()), ("n", pa.int64()))}})

    dealt = rows.mapInArrow(deal, "tree int, top int, rows binary")
    return materialize(dealt.groupBy("tree", "top").applyInArrow(
        finish, "tree int, top int, sub int, feature int, threshold double, left int, right int, value double, "
                "gain double, n long"), "subtrees")


def _stitch(spark: SparkSession, nodes: Nodes, small, grown: DataFrame) -> DataFrame:
    """Levels and subtrees as one table; the nodes of a tree are numbered
    levels first, then subtree by subtree (a subtree's root takes its top's
    place, its other nodes follow at the subtree's offset).  ``part`` is the
    number of the subtree's root, -1 for the split nodes of the levels."""
    sizes = {(r["tree"], r["top"]): r["count"] for r in grown.groupBy("tree", "top").count().collect()}
    number = np.zeros(len(nodes), np.int64)
    used: dict[int, int] = {}
    for i, t in enumerate(nodes.tree.tolist()):  # parents come before children
        number[i] = used.get(t, 0)
        used[t] = int(number[i]) + 1
    offsets = []
    for (t, top), size in sorted(sizes.items()):
        offsets.append((t, top, int(number[top]), used[t] - 1))
        used[t] += size - 1
    own = [(int(nodes.tree[i]), int(number[i]), int(nodes.feature[i]), float(nodes.threshold[i]),
            int(number[nodes.left[i]]) if nodes.feature[i] >= 0 else -1,
            int(number[nodes.right[i]]) if nodes.feature[i] >= 0 else -1, float(nodes.value[i]),
            float(nodes.gain[i]), int(nodes.n[i])) for i in range(len(nodes))
           if (int(nodes.tree[i]), i) not in sizes]
    top = spark.createDataFrame(own, _NODE_SCHEMA).withColumn(
        "part", F.when(F.col("feature") < 0, F.col("node")).otherwise(F.lit(-1)))
    place = spark.createDataFrame(offsets, "tree int, top int, number int, off int")

    def moved(c: str) -> Column:  # position 0 is the top itself
        return F.when(F.col(c) < 0, -1).when(F.col(c) == 0, F.col("number")).otherwise(F.col(c) + F.col("off"))

    below = grown.join(F.broadcast(place), ["tree", "top"]).select(
        "tree", moved("sub").cast("int").alias("node"), "feature", "threshold", moved("left").cast("int").alias("left"),
        moved("right").cast("int").alias("right"), "value", "gain", "n", F.col("number").alias("part"))
    return top.unionByName(below)


def _score_parts(table: DataFrame, n_trees: int, df: DataFrame, features: str) -> DataFrame:
    """``df`` with ``_sum``, the sum of its rows' leaf values.  The levels of
    ``TREES_AT_ONCE`` trees travel to the rows, which are dealt to the subtrees
    they end in; each subtree meets its rows in a task group of its own.  Values
    are added up in the order of the trees, so reruns agree."""
    spark = df.sparkSession
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "scored_rows")
    x = rows.select("_row", vector_to_array(features).alias("x"))
    names = [f.name for f in fields(Nodes)]
    passes = None
    for first in range(0, n_trees, TREES_AT_ONCE):
        trees = table.where(F.col("tree").between(first, min(n_trees, first + TREES_AT_ONCE) - 1))
        upper = trees.where("part < 0").select("tree", "node", "feature", "threshold", "left", "right").toArrow()
        levels = spark.sparkContext.broadcast(
            (list(range(first, min(n_trees, first + TREES_AT_ONCE))),
             {c: upper[c].to_numpy() for c in upper.column_names}))

        def deal(batches: Iterator[pa.RecordBatch], levels=levels) -> Iterator[pa.RecordBatch]:
            numbers, table = levels.value
            found = []
            for t in numbers:
                mine = np.flatnonzero(table["tree"] == t)
                mine = mine[np.argsort(table["node"][mine])]
                found.append((t, {c: v[mine] for c, v in table.items()}))
            for batch in batches:
                column = batch.column("x")
                if not len(column):
                    continue
                ids, x = batch.column("_row").to_numpy(), column.flatten().to_numpy(zero_copy_only=False)
                x = x.reshape(len(column), -1)
                for t, nodes in found:
                    end = _walk(x, nodes["node"], nodes["feature"], nodes["threshold"], nodes["left"], nodes["right"])
                    order = np.argsort(end, kind="stable")
                    parts, begin = np.unique(end[order], return_index=True)
                    cut = np.split(order, begin[1:])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t] * len(parts), pa.int32()), pa.array(parts, pa.int32()),
                         pa.array([ids[c].astype("<i8").tobytes() for c in cut], pa.binary()),
                         pa.array([x[c].astype("<f8").tobytes() for c in cut], pa.binary())],
                        ["tree", "part", "ids", "x"])

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            ids = np.frombuffer(b"".join(left["ids"].to_pylist()), "<i8")
            values = np.zeros(len(ids))
            if len(ids):
                x = np.frombuffer(b"".join(left["x"].to_pylist()), "<f8").reshape(len(ids), -1)
                order = np.argsort(right["node"].to_numpy())
                node, feature, threshold, low, high, value = (
                    right[c].to_numpy()[order] for c in ("node", "feature", "threshold", "left", "right", "value"))
                inner = feature >= 0
                end = _walk(x, node[inner], feature[inner], threshold[inner], low[inner], high[inner],
                            right["part"][0].as_py())
                values = value[np.searchsorted(node, end)]
            tree = left["tree"][0].as_py() if len(ids) else 0
            return pa.table({"_row": pa.array(ids, pa.int64()), "tree": pa.array([tree] * len(ids), pa.int32()),
                             "value": pa.array(values)})

        dealt = x.mapInArrow(deal, "tree int, part int, ids binary, x binary")
        met = dealt.groupBy("tree", "part").cogroup(
            trees.where("part >= 0").select(*names, "part").groupBy("tree", "part")).applyInArrow(
            meet, "_row long, tree int, value double")
        sums = materialize(met.groupBy("_row").agg(_ordered_sum("tree", "value").alias("value"))
                           .withColumn("tree", F.lit(first)), "leaf_sums")
        passes = sums if passes is None else passes.unionByName(sums)
    total = passes.groupBy("_row").agg(_ordered_sum("tree", "value").alias("_sum"))
    return rows.join(total, "_row").drop("_row")


def _ordered_sum(by: str, value: str) -> Column:
    in_order = F.array_sort(F.collect_list(F.struct(by, value)))
    return F.aggregate(in_order, F.lit(0.0), lambda total, v: total + v[value])


def _walk(x, number, feature, threshold, left, right, start: int = 0):
    """The node every row of ``x`` leaves at, from ``start`` through the split
    nodes of these ascending numbers."""
    at = np.full(len(x), start)
    moving = np.arange(len(x)) if len(number) else np.zeros(0, np.int64)
    while len(moving):
        place = np.minimum(np.searchsorted(number, at[moving]), len(number) - 1)
        inside = number[place] == at[moving]
        moving, place = moving[inside], place[inside]
        at[moving] = np.where(x[moving, feature[place]] <= threshold[place], left[place], right[place])
    return at


def _settled(params: dict | None, n_features: int, local_rows: int) -> dict:
    p = {**EXTRA_TREES_DEFAULTS, **{k: v for k, v in (params or {}).items() if k != "limit_depth"}}
    share = p["max_features"]
    m = math.sqrt(n_features) if share == "sqrt" else math.log2(n_features) if share == "log2" \
        else share * n_features if isinstance(share, float) else share
    return {**p, "m": max(1, min(n_features, int(m))), "n_features": n_features, "local_rows": local_rows}


@dataclass
class TreeModel:
    """A fitted tree ensemble: its written node table, and what to make of
    the sum of its leaf values (``mean`` of probabilities or ``logit``)."""

    table: DataFrame
    n_trees: int
    n_features: int
    kind: str = "mean"
    start: float = 0.0

    def nodes(self, trees: tuple[int, int] | None = None) -> Nodes:
        rows = self.table if trees is None else self.table.where(F.col("tree").between(*trees))
        t = rows.select(*[f.name for f in fields(Nodes)]).orderBy("tree", "node").toArrow()
        cols = {f.name: t[f.name].to_numpy() for f in fields(Nodes)}
        first = np.concatenate(([0], np.cumsum(np.bincount(cols["tree"] - cols["tree"].min()))))[
            cols["tree"] - cols["tree"].min()]
        for side in ("left", "right"):
            cols[side] = np.where(cols[side] >= 0, cols[side] + first, -1)
        return Nodes(**cols)

    def with_probability(self, df: DataFrame, features: str = "features", out: str = "prob_up") -> DataFrame:
        """Adds P(label 1).  An ensemble of up to ``SCORING_NODES`` nodes goes to
        the tasks; of a larger one only the levels do, and rows meet subtrees
        (:func:`_score_parts`).  Node tables without subtrees (boosted trees)
        go to the tasks ``SCORING_NODES`` nodes at a time."""
        counts = [r["count"] for r in self.table.groupBy("tree").count().orderBy("tree").collect()]
        if sum(counts) > SCORING_NODES and "part" in self.table.columns:
            rows = _score_parts(self.table, len(counts), df, features).withColumn(
                "_sum", F.col("_sum") + F.lit(self.start))
        else:
            rows = self._score_whole(counts, df, features)
        value = F.col("_sum") / F.lit(self.n_trees) if self.kind == "mean" else 1 / (1 + F.exp(-F.col("_sum")))
        return rows.withColumn(out, value).drop("_sum")

    def _score_whole(self, counts: list[int], df: DataFrame, features: str) -> DataFrame:
        groups, first, held = [], 0, 0
        for t, c in enumerate(counts):
            if held and held + c > SCORING_NODES:
                groups.append((first, t - 1))
                first, held = t, 0
            held += c
        groups.append((first, len(counts) - 1))
        rows = df.withColumn("_sum", F.lit(self.start))
        for i, trees in enumerate(groups):
            rows = rows.withColumn("_sum", F.col("_sum") + self._leaf_sum(df.sparkSession, trees)(
                vector_to_array(features)))
            if len(groups) > 1 and i < len(groups) - 1:
                rows = materialize(rows, "scores")
        return rows

    def _leaf_sum(self, spark: SparkSession, trees: tuple[int, int]):
        shared = spark.sparkContext.broadcast(self.nodes(trees))

        @F.arrow_udf("double")
        def leaf_sum(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            nodes = shared.value
            for a in batches:
                x = a.flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1) if len(a) else np.zeros((0, 1))
                total = np.zeros(len(a))
                for start in nodes.roots().tolist():
                    total += nodes.value[descend(x, nodes, start)]
                yield pa.array(total)

        return leaf_sum

    def importances(self) -> np.ndarray:
        """By feature: every tree's shares of its gain, averaged (mean kind),
        or the shares of all splits (boosted trees)."""
        worth = F.sum("gain") if self.kind == "mean" else F.count("*").cast("double")
        g = self.table.where("feature >= 0").groupBy("tree", "feature").agg(worth.alias("g")).toArrow()
        per = np.zeros((self.n_trees, self.n_features))
        per[g["tree"].to_numpy(), g["feature"].to_numpy()] = g["g"].to_numpy()
        if self.kind == "mean":
            whole = per.sum(1, keepdims=True)
            per = np.divide(per, whole, out=np.zeros_like(per), where=whole > 0)
        total = per.sum(0)
        return total / total.sum() if total.sum() > 0 else total

    # ---- writer and reader
    def save(self, path: str) -> None:
        """A folder with the node table and one row of facts."""
        self.table.write.mode("errorifexists").parquet(f"{path}/nodes")
        facts = [(self.n_trees, self.n_features, self.kind, float(self.start))]
        self.table.sparkSession.createDataFrame(
            facts, "n_trees int, n_features int, kind string, start double").coalesce(1).write.parquet(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TreeModel:
        facts = spark.read.parquet(f"{path}/facts").first()
        return cls(spark.read.parquet(f"{path}/nodes"), facts["n_trees"], facts["n_features"], facts["kind"],
                   facts["start"])


def fit_extra_trees(train: DataFrame, params: dict | None = None, features: str = "features",
                    local_rows: int = LOCAL_ROWS) -> TreeModel:
    """ML7: ``train`` has ``features`` (vector), ``label`` (0/1) and, if any,
    ``weight``.  Parameters as in ``EXTRA_TREES_DEFAULTS``."""
    rows = training_rows(train, features)
    head = rows.select(F.size("x").alias("p")).first()
    if head is None:
        raise ValueError("no training rows")
    settled = _settled(params, head["p"], local_rows)
    table = None
    for first in range(0, settled["n_estimators"], TREES_AT_ONCE):
        trees = range(first, min(settled["n_estimators"], first + TREES_AT_ONCE))
        part = _grow_group(rows, trees, head["p"], settled)
        table = part if table is None else table.unionByName(part)
    return TreeModel(materialize(table, "trees"), settled["n_estimators"], head["p"])
