"""Chunked cubic interpolation (halo in knots) equals a whole-series solve;
linear interpolation follows pandas' positional rule."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from candleflow.operators import fill as FL
from candleflow.plans.series import with_bar_no


def whole_spline(x, y, xq):
    """Not-a-knot spline from its defining equations, solved densely: values
    and slopes agree at the knots, third derivatives at the second knots."""
    n, h, s = len(x), np.diff(x), np.diff(y) / np.diff(x)
    a, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        r[i] = 6 * (s[i] - s[i - 1])
    a[0, :3] = 1 / h[0], -1 / h[0] - 1 / h[1], 1 / h[1]
    a[-1, -3:] = 1 / h[-2], -1 / h[-2] - 1 / h[-1], 1 / h[-1]
    m = np.linalg.solve(a, r)
    j = np.clip(np.searchsorted(x, xq) - 1, 0, n - 2)
    t = xq - x[j]
    return y[j] + t * (s[j] - h[j] * (2 * m[j] + m[j + 1]) / 6) + t ** 2 * m[j] / 2 + t ** 3 * (m[j + 1] - m[j]) / (6 * h[j])


@pytest.mark.parametrize("chunk", [200, 2000, 1 << 18])
def test_cubic_equals_whole_series_at_any_chunk_length(spark, chunk):
    rng = np.random.default_rng(7)
    rows = []
    for s, n in (("A", 1300), ("B", 40), ("C", 4)):
        y = np.cumsum(rng.normal(0, 1, n)) + 100
        for t in range(n):
            gone = 500 <= t < 900 if s == "A" else False  # a gap longer than any halo
            v = None if gone or (1 < t < n - 2 and rng.random() < 0.3) else float(y[t])
            rows.append((s, dt.date(2000, 1, 1) + dt.timedelta(days=int(t * 1.5)), v))
    rows += [("L", dt.date(2000, 1, 1) + dt.timedelta(days=t), v)
             for t, v in enumerate([None, 1.0, None, 4.0, None])] + [("N", dt.date(2000, 1, 1), None)]
    df = with_bar_no(spark.createDataFrame(rows, "symbol string, ts date, close double"))
    got = FL.interpolate_cubic(df, "close", chunk_bars=chunk).toPandas()
    for sym, g in got.groupby("symbol"):
        g = g.sort_values("bar_no")
        src = [r for r in rows if r[0] == sym]
        x = np.array([pd.Timestamp(r[1]).value / 1e9 for r in src])
        y = np.array([np.nan if r[2] is None else r[2] for r in src])
        if sym in "LN":
            exp = np.array([np.nan, 1.0, 2.5, 4.0, np.nan] if sym == "L" else [np.nan])
        else:
            k = ~np.isnan(y)
            exp = np.where(k, y, whole_spline(x[k], y[k], x))
        assert np.allclose(g["close"].to_numpy(dtype=float), exp, rtol=1e-7, atol=1e-6, equal_nan=True), sym


def test_linear_matches_pandas(spark, small_chunks):
    vals = [None, 1.0, None, None, 4.0, None, 10.0, None, None]
    rows = [("A", dt.date(2000, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(vals)]
    df = with_bar_no(spark.createDataFrame(rows, "symbol string, ts date, close double"))
    got = FL.interpolate_linear(df, "close").orderBy("bar_no").toPandas()["close"].to_numpy(dtype=float)
    exp = pd.Series(vals, dtype=float).interpolate().to_numpy()
    assert np.allclose(got, exp, equal_nan=True)
