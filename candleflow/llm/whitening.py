"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation (operator 13).

Vectors
    An entry c becomes the long x = floor(1024 c) + 100000.  The matrix is the
    x-vectors less their means; sums per dimension are exact.

Bidiagonalisation
    ``X v`` and ``X' u`` alternate, each step being one distributed pass over
    the rows: a task multiplies its rows by the new right vector, and hands on
    the products of the result with every earlier left vector and with
    the rows themselves (``d + k`` sums a task, added up by Spark).  A left vector has a
    number for every row of the table; it is kept as its coefficients, u = X y
    with y of length d, and worked out again from the rows where it is
    needed, so no vector of the table's length is ever stored or sent.  Both
    families are fully reorthogonalised.  If a direction is exhausted (repeated
    eigenvalues, fewer rows than dimensions), the next one is any direction
    orthogonal to all before it.  Steps end when the residual of every wanted
    component is below ``TOLERANCE`` of its singular value, at the latest after
    d steps, when the bidiagonal matrix holds all of the matrix.

Components
    The singular value decomposition of the small bidiagonal matrix gives unit
    eigenvectors of the covariance V (divisor n) and the deviations, the square
    roots of its eigenvalues.  Eigenvalues below ``RANK`` of the largest are
    zero to double precision: whitening divides by them, so they are no
    components and yield no rows.

Defined cases: rows whose vector is null, empty or holds a null, non-finite
or (after scaling, beyond +-2^52) unrepresentable entry are dropped; so are
rows whose length is not the most frequent one (ties: the longer), as no
covariance joins them; null ids and repeated rows are kept, each row counting
for itself; an empty table, one row, or equal rows have no component and give
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .share import share, shared

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
TOLERANCE = 1e-14
RANK = 1e-13
#: rows multiplied at once
BLOCK = 4096


def quantised(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``x`` (longs) of the rows that can be used."""
    entry = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE))
    usable = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double"))
                      & (F.abs(c.cast("double") * SCALE) < float(1 << 52)))
    rows = table.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(usable, F.lit(False)))
    rows = materialize(rows.select(F.col(id_col).alias("id"), F.transform(
        entry, lambda c: c.cast("long") + F.lit(SHIFT).cast("long")).alias("x")), "vectors")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (common["d"] if common else 0))


def _matrix(column) -> object:
    """An Arrow list column of equal lengths -> a 2-d array of longs."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64, copy=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], centre):
    """The centred rows of a task, block by block."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            if part.num_rows:
                yield part, _matrix(part.column("x")) - centre


class Rows:
    """The centred matrix, as passes over the stored rows."""

    def __init__(self, rows: DataFrame) -> None:
        import numpy as np

        self.frame = rows
        first = rows.select(F.size("x").alias("d")).first()
        d = self.d = first["d"] if first else 0
        sums = self._sums(lambda blocks: sum((x.sum(0) for _, x in blocks), np.zeros(d, np.int64)),
                          np.zeros(d, np.int64), "long")
        self.sums = [int(s) for s in sums]
        self.n = rows.count() if self.d else 0
        self.centre = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(0)

    def _sums(self, work, centre, kind: str = "double"):
        """``work(blocks)`` gives each task's vector; their sum."""
        import numpy as np

        packed = share(self.frame.sparkSession, (work, centre))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f, c = shared(packed)
            out = np.asarray(f(_blocks(batches, c)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["i", "v"])

        total = self.frame.select("x").mapInArrow(run, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")) \
                    .orderBy("i").toArrow()
        packed.unpersist()
        return total["v"].to_numpy()

    def product(self, y, earlier):
        """For w = X y: the norm of w, its products with X times each column
        of ``earlier``, and X' w."""
        import numpy as np

        d, k = self.d, earlier.shape[1]

        def work(blocks):
            out = np.zeros(1 + k + d)
            for _, x in blocks:
                w = x @ y
                out[0] += w @ w
                out[1:1 + k] += (x @ earlier).T @ w
                out[1 + k:] += x.T @ w
            return out

        total = self._sums(work, self.centre)
        return total[0], total[1:1 + k], total[1 + k:]

    def gramian(self, directions):
        """D' X' X D for a few directions D."""
        import numpy as np

        k = directions.shape[1]

        def work(blocks):
            out = np.zeros((k, k))
            for _, x in blocks:
                w = x @ directions
                out += w.T @ w
            return out.ravel()

        return self._sums(work, self.centre).reshape(k, k)

    def spread(self) -> float:
        """The sum of all squared centred entries."""
        import numpy as np

        return float(self._sums(lambda blocks: np.array([sum((float((x * x).sum()) for _, x in blocks), 0.0)]),
                                self.centre)[0])


@dataclass
class Components:
    directions: object  # d x k unit vectors
    variances: object  # k eigenvalues of the covariance, falling
    steps: int


def _fresh(rng, basis):
    """A unit vector orthogonal to the columns of ``basis``."""
    import numpy as np

    v = rng.standard_normal(basis.shape[0])
    for _ in range(3):
        v -= basis @ (basis.T @ v)
    return v / np.linalg.norm(v)


def bidiagonalise(rows: Rows, wanted: int = COMPONENTS, seed: int = 29) -> Components:
    """The leading components of the rows' covariance."""
    import numpy as np

    d, n = rows.d, rows.n
    empty = Components(np.zeros((d, 0)), np.zeros(0), 0)
    if n < 2:
        return empty
    rng = np.random.default_rng(seed)
    right, left, images = (np.zeros((d, 0)) for _ in range(3))  # v, y (u = X y) and X' u
    alphas, betas = [], []
    v, beta = _fresh(rng, right), 0.0
    size = 0.0
    while True:
        k = right.shape[1]
        # u = X v - beta u_before, orthogonal to every u
        start = v - (beta * left[:, -1] if k else 0.0)
        square, along, image = rows.product(start, left)
        square = max(0.0, square - float(along @ along))
        alpha = float(np.sqrt(square))
        size = max(size, alpha, beta)
        right = np.column_stack([right, v])
        if alpha <= 1e-13 * size or not alpha:
            alpha, y, image = 0.0, np.zeros(d), np.zeros(d)
        else:
            y = (start - left @ along) / alpha
            image = (image - images @ along) / alpha
        left, images = np.column_stack([left, y]), np.column_stack([images, image])
        alphas.append(alpha)
        # v = X' u - alpha v, orthogonal to every v
        after = image - alpha * v
        for _ in range(2):
            after = after - right @ (right.T @ after)
        beta = float(np.linalg.norm(after))
        ended = beta <= 1e-13 * size
        b = np.diag(alphas) + np.diag(betas, 1)
        p, sigma, qt = np.linalg.svd(b)
        some = min(wanted, len(sigma))
        if len(alphas) == d or (not ended and len(sigma) > wanted
                                and (beta * np.abs(p[-1, :some]) <= TOLERANCE * sigma[:some]).all()):
            break
        if ended:
            beta, v = 0.0, _fresh(rng, right)
        else:
            v = after / beta
        betas.append(beta)
    keep = [i for i in range(some) if sigma[i] ** 2 > RANK * sigma[0] ** 2 and sigma[i] > 0]
    directions = right @ qt[keep].T
    if not keep:
        return empty
    directions, _ = np.linalg.qr(directions)
    return Components(directions, sigma[keep] ** 2 / n, len(alphas))


def whiten(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector: ``id``, ``n``, ``deviation`` (decimal, exact),
    ``whitened`` (array, a value for every component), ``explained`` (array)
    and ``identity_error``."""
    import numpy as np

    spark = table.sparkSession
    kept = quantised(table, id_col, vector)
    rows = Rows(kept)
    found = bidiagonalise(rows, components)
    k, n, sums = len(found.variances), rows.n, rows.sums
    weights = found.directions / np.sqrt(found.variances)[None, :] if k else np.zeros((rows.d, 0))
    trace = rows.spread() / n if n else 0.0
    explained = [float(e / trace) for e in found.variances] if trace else []
    error = float(np.abs(rows.gramian(weights) / n - np.eye(k)).max()) if k else 0.0
    packed = share(spark, (rows.centre, weights, n, np.array(sums, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, w, count, total = shared(packed)
        for part, x in _blocks(batches, 0):
            off = count * x - total
            most = int(np.abs(off).max(initial=0))
            if most * most * max(1, off.shape[1]) < 1 << 62:
                deviation = [int(s) for s in (off * off).sum(1)]
            else:
                deviation = [sum(int(o) ** 2 for o in r) for r in off]
            from decimal import Decimal

            white = (x - centre) @ w
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([Decimal(s) for s in deviation], pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]),
                                          pa.array(white.ravel()))], ["id", "deviation", "whitened"])

    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(run, f"id {kind}, deviation decimal(38,0), whitened array<double>").select(
        "id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(e) for e in explained]).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"))


def by_component(whitened: DataFrame) -> DataFrame:
    """One row for each vector and component, numbered from 1."""
    return whitened.select("id", "n", "deviation", "identity_error",
                           F.posexplode(F.arrays_zip("whitened", "explained")).alias("component", "c")) \
        .select("id", (F.col("component") + 1).alias("component"), "n", "deviation",
                F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
