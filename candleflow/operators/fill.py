"""Gap filling over series positions: forward/back fill, linear and cubic
interpolation.

Forward/back fill are two-level scans (see ``plans.series``).  Linear
interpolation needs the previous and next known point, i.e. one forward and
one backward carry.  Cubic interpolation first solves for the second
derivatives at the *known* points: these are numbered on their own, and each
(symbol, chunk of knots) is solved with a halo of ``CUBIC_HALO`` knots on
both sides, since a knot's influence decays by ~0.27 per knot.  A gap then
takes the two knots around it by a carry, however long it is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candleflow.plans.series import (BAR, CHUNK, KEY, _cb, carry_last, carry_next, over_chunks,
                                     with_bar_no)
from candleflow.session import materialize

CUBIC_HALO = 64


def ffill(df: DataFrame, cols: list[str], key: str = KEY) -> DataFrame:
    """Replace nulls by the last known value of the same series (``ffill``)."""
    return carry_last(df, list(cols), None, key)


def bfill(df: DataFrame, cols: list[str], key: str = KEY) -> DataFrame:
    """Replace nulls by the next known value of the same series (``bfill``)."""
    return carry_next(df, list(cols), None, key)


def interpolate_linear(df: DataFrame, col: str, key: str = KEY) -> DataFrame:
    """Positional linear interpolation (pandas ``method="linear"``).

    Interior gaps are interpolated on bar positions; trailing gaps repeat the
    last value; leading gaps stay NULL.
    """
    pos = F.when(F.col(col).isNotNull(), F.col(BAR).cast("double"))
    staged = df.withColumn("_pv", F.col(col)).withColumn("_pp", pos)
    staged = carry_last(staged, ["_pv", "_pp"], ["_prev_v", "_prev_p"], key)
    staged = carry_next(staged, ["_pv", "_pp"], ["_next_v", "_next_p"], key)
    frac = (F.col(BAR) - F.col("_prev_p")) / (F.col("_next_p") - F.col("_prev_p"))
    filled = (F.when(F.col(col).isNotNull(), F.col(col))
              .when(F.col("_prev_v").isNull(), F.lit(None).cast("double"))
              .when(F.col("_next_v").isNull(), F.col("_prev_v"))
              .otherwise(F.col("_prev_v") + (F.col("_next_v") - F.col("_prev_v")) * frac))
    return (staged.withColumn(col, filled)
            .drop("_pv", "_pp", "_prev_v", "_prev_p", "_next_v", "_next_p"))


def _second_derivatives(x: np.ndarray, y: np.ndarray, first: bool, last: bool) -> np.ndarray:
    """Second derivatives of the cubic spline at its knots (Thomas solve).

    An end of the series is not-a-knot (the third derivative is continuous at
    the second knot); an end of a chunk's halo is natural.
    """
    n = len(x)
    m = np.zeros(n)
    if n < 3:
        return m
    h = np.diff(x)
    slope = np.diff(y) / h
    if n == 3 and first and last:  # both ends: the parabola through the points
        m[:] = 2.0 * (slope[1] - slope[0]) / (x[2] - x[0])
        return m
    a, c = h[:-1].copy(), h[1:].copy()
    b, d = 2.0 * (a + c), 6.0 * np.diff(slope)
    h0, h1, g0, g1 = h[0], h[1], h[-2], h[-1]
    if first:
        b[0] += h0 * (h0 + h1) / h1
        c[0] -= h0 * h0 / h1
    if last:
        b[-1] += g1 * (g0 + g1) / g0
        a[-1] -= g1 * g1 / g0
    k = len(b)
    for i in range(1, k):
        w = a[i] / b[i - 1]
        b[i] -= w * c[i - 1]
        d[i] -= w * d[i - 1]
    m[k] = d[-1] / b[-1]
    for i in range(k - 2, -1, -1):
        m[i + 1] = (d[i] - c[i] * m[i + 2]) / b[i]
    if first:
        m[0] = ((h0 + h1) * m[1] - h0 * m[2]) / h1
    if last:
        m[-1] = ((g0 + g1) * m[-2] - g1 * m[-3]) / g0
    return m


def _knot_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_kn")
    kn = pdf["_kn"].to_numpy()
    m = _second_derivatives(pdf["_x"].to_numpy(), pdf["_y"].to_numpy(), bool(kn[0] == 0),
                            bool(pdf["_end"].to_numpy()[-1]))
    keep = pdf["_home"].to_numpy() == pdf[CHUNK].to_numpy()
    return pd.DataFrame({KEY: pdf[KEY].to_numpy()[keep], BAR: pdf[BAR].to_numpy()[keep], "_m": m[keep]})


_KNOT_SCHEMA = T.StructType([T.StructField(KEY, T.StringType()), T.StructField(BAR, T.LongType()),
                             T.StructField("_m", T.DoubleType())])


def interpolate_cubic(df: DataFrame, col: str, x: str = "ts", key: str = KEY,
                      chunk_bars: int | None = None, halo: int = CUBIC_HALO) -> DataFrame:
    """Cubic-spline interpolation of interior gaps over the time axis ``x``
    (epoch seconds), not-a-knot at the ends of a series."""
    chunk_bars = _cb(chunk_bars)
    halo = min(halo, chunk_bars)
    staged = df.withColumn("_x", F.unix_seconds(F.col(x).cast("timestamp")).cast("double")) \
               .withColumn("_y", F.col(col).cast("double"))
    known = staged.filter(F.col("_y").isNotNull()).select(key, x, BAR, "_x", "_y")
    knots = with_bar_no(known.withColumnRenamed(BAR, "_bar"), key, x)
    knots = over_chunks(knots, lambda d, w: d.withColumn("_end", F.lead(BAR, 1).over(w).isNull()), 0, 1, key,
                        chunk_bars=max(2, chunk_bars))
    knots = knots.withColumnsRenamed({BAR: "_kn", "_bar": BAR})
    home = F.floor(F.col("_kn") / F.lit(chunk_bars))
    pos = F.col("_kn") - home * F.lit(chunk_bars)
    copies = F.filter(F.array(home, F.when(pos >= chunk_bars - halo, home + 1),
                              F.when((pos < halo) & (home > 0), home - 1)), lambda v: v.isNotNull())
    dealt = knots.withColumn("_home", home).withColumn(CHUNK, F.explode(copies))
    # a copy into a chunk after the last one has no home rows and yields nothing
    solved = dealt.groupBy(key, CHUNK).applyInPandas(_knot_chunk, _KNOT_SCHEMA)
    rows = materialize(staged.join(solved, [key, BAR], "left"), "knots")
    at = [F.when(F.col("_y").isNotNull(), F.col(c)) for c in ("_x", "_y", "_m")]
    rows = rows.withColumns({"_kx": at[0], "_ky": at[1], "_km": at[2]})
    rows = carry_last(rows, ["_kx", "_ky", "_km"], ["_x0", "_y0", "_m0"], key)
    rows = carry_next(rows, ["_kx", "_ky", "_km"], ["_x1", "_y1", "_m1"], key)
    x0, y0, m0, x1, y1, m1, q = (F.col(c) for c in ("_x0", "_y0", "_m0", "_x1", "_y1", "_m1", "_x"))
    h = x1 - x0
    inside = (m0 * F.pow(x1 - q, 3) / (6 * h) + m1 * F.pow(q - x0, 3) / (6 * h)
              + (y0 / h - m0 * h / 6) * (x1 - q) + (y1 / h - m1 * h / 6) * (q - x0))
    helpers = [c for c in rows.columns if c.startswith("_") and c not in df.columns]
    return rows.withColumn(col, F.coalesce(F.col("_y"), inside)).drop(*helpers)
