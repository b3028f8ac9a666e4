"""Embedding near-duplicates by collision-counting projections (operator 4).

Vectors are compared within a label (and length) by cosine in double
precision.  On the unit sphere cosine >= t means distance <= sqrt(2 - 2t).
Vectors are projected on ``PROJECTIONS`` random unit vectors.  Each projection
is sorted; a query's window is everything within ``WIDTH`` standard
deviations of the projected threshold distance around its own value, and a
pair's count is the number of windows it falls into.  Pairs that reach the
count are verified by their cosine.

The count is calibrated: it is the largest one that pairs exactly at the
threshold reach with probability ``RECALL`` over random directions, measured
with the projections in use (closer pairs reach it more often).

Equal vectors of a label are one representative with a multiplicity.  The
representatives of a label are dealt to blocks of about ``BLOCK`` by a hash,
and every pair of blocks is a task group of its own, so a label of any size is
spread and no group is capped.  A group returns sums of links and links to
the first member of each locally connected set, never all pairs.

The work inside a label is quadratic with a small constant (about 40
nanoseconds a pair): in high dimensions one-dimensional windows that keep
the recall cannot be narrow.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null label, link with nothing; a null id never
becomes a component id unless all ids are null; repeated rows are separate
vectors; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import stars

COSINE = 0.93
PROJECTIONS = 24
WIDTH = 1.2
RECALL = 0.9999
BLOCK = 1500
SEED = 11


def projections(dim: int, n: int = PROJECTIONS, seed: int = SEED):
    """``n`` random unit vectors, as rows."""
    import numpy as np

    a = np.random.default_rng([seed, dim]).standard_normal((n, dim))
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def calibrated_count(a, half: float, distance: float, recall: float = RECALL, seed: int = SEED) -> int:
    """Largest count that ``recall`` of the pairs at ``distance`` reach."""
    import numpy as np

    u = np.random.default_rng([seed, 1]).standard_normal((40_000, a.shape[1]))
    u *= distance / np.linalg.norm(u, axis=1, keepdims=True)
    counts = np.sort((np.abs(u @ a.T) <= half).sum(axis=1))
    return int(counts[int((1 - recall) * len(counts))])


def collision_pairs(x, y, same: bool, cosine: float, n: int = PROJECTIONS, recall: float = RECALL):
    """Verified links between the unit rows of ``x`` and ``y`` as a boolean
    matrix (the upper triangle if they are the same block)."""
    import numpy as np

    distance = float(np.sqrt(2 - 2 * cosine))
    a = projections(x.shape[1], n)
    half = WIDTH * distance / np.sqrt(x.shape[1])
    need = calibrated_count(a, half, distance, recall)
    counts = np.zeros((len(x), len(y)), np.uint8)
    for direction in a:
        px, py = x @ direction, y @ direction
        order = np.argsort(py, kind="stable")
        py = py[order]
        # query-centred windows in the sorted projection
        lo = np.searchsorted(py, px - half - 1e-12).tolist()
        hi = np.searchsorted(py, px + half + 1e-12, side="right").tolist()
        for q, (i, j) in enumerate(zip(lo, hi)):
            counts[q, order[i:j]] += 1
    passing = counts >= need
    if same:
        passing &= np.triu(np.ones(passing.shape, bool), 1)
    q, c = np.nonzero(passing)
    links = np.zeros(passing.shape, bool)
    for at in range(0, len(q), 1 << 16):
        i, j = q[at:at + (1 << 16)], c[at:at + (1 << 16)]
        links[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= cosine
    return links


def _local_stars(links, same: bool) -> list[tuple[int, int]]:
    """(member, first member) over the local rows: x's, then y's (the same
    rows if the block is paired with itself)."""
    import numpy as np

    shift = 0 if same else links.shape[0]
    label = np.arange(shift + links.shape[1])
    for q in np.flatnonzero(links.any(axis=1)).tolist():
        members = np.append(np.flatnonzero(links[q]) + shift, q)
        roots = np.unique(label[members])
        if len(roots) > 1:
            label[np.isin(label, roots)] = roots[0]
    moved = np.flatnonzero(label != np.arange(len(label)))
    return list(zip(moved.tolist(), label[moved].tolist()))


def link_embeddings(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                    label: str = "label", cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """One row per row of ``rows``: ``id``, ``n_links``, ``component``."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col(label).isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) \
        & F.exists(v, lambda c: c != 0)
    rows = rows.select(F.col(id_col).alias("id"), F.col(label).alias("l"), v.alias("v"),
                       F.coalesce(usable, F.lit(False)).alias("ok"))
    # rep: a number for each distinct vector of a label, written once so that
    # it stays the same wherever it is read again
    keyed = rows.where("ok").groupBy("l", "v").agg(F.count("*").alias("mult"), F.min("id").alias("least"))
    reps = cut(keyed.withColumn("rep", F.monotonically_increasing_id()))
    sizes = reps.groupBy("l", F.size("v").alias("d")).agg(
        F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
    dealt = reps.withColumn("d", F.size("v")).join(sizes, ["l", "d"]) \
        .withColumn("b", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int")) \
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))) \
        .select("l", "d", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "rep", "mult", "v")

    def solve(group: pa.Table) -> pa.Table:
        import numpy as np

        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        group = group.sort_by("rep")
        b = group["b"].to_numpy()
        x = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow for any finite vector
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        reps, mult = group["rep"].to_numpy(), group["mult"].to_numpy()
        left, right = b == i, b == j
        links = collision_pairs(x[left], x[right], i == j, cosine)
        out = []  # (rep, links, smaller rep)
        for side, n in ((left, links @ mult[right]), (right, mult[left] @ links)):
            out += [(int(r), int(k), None) for r, k in zip(reps[side], n) if k]
        local = reps[left] if i == j else np.concatenate([reps[left], reps[right]])
        out += [(int(local[m]), 0, int(local[f])) for m, f in _local_stars(links, i == j)]
        return pa.table({"rep": pa.array([o[0] for o in out], pa.int64()),
                         "n": pa.array([o[1] for o in out], pa.int64()),
                         "to": pa.array([o[2] for o in out], pa.int64())})

    found = cut(dealt.groupBy("l", "d", "i", "j").applyInArrow(solve, "rep long, n long, to long"))
    star = stars(found.where("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    degree = found.where("to is null").groupBy("rep").agg(F.sum("n").alias("n"))
    named = reps.join(degree, "rep", "left").join(star.withColumnRenamed("a", "rep"), "rep", "left") \
        .select("l", "v", "least", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                F.coalesce("b", "rep").alias("g"))
    least = named.groupBy("g").agg(F.min("least").alias("component"))
    named = named.join(least, "g").select("l", "v", "n_links", "component")
    some = rows.where("ok").join(named, ["l", "v"]).select("id", "n_links", "component")
    none = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return some.unionByName(none)
