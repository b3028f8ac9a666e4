"""Series primitives against sequential brute force, with chunks and blocks
small enough that every boundary case is crossed."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from candleflow.plans.series import (block_size, carry_last, carry_next, linear_recurrence,
                                     over_chunks, running_sum, with_bar_no)

Q = 13.0 / 14.0
B = block_size(Q)


def panel(spark, lengths, seed=0, null_frac=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for i, n in enumerate(lengths):
        x = rng.normal(100, 5, n)
        for t in range(n):
            v = None if rng.random() < null_frac else float(x[t])
            rows.append((f"S{i}", dt.date(2000, 1, 1) + dt.timedelta(days=3 * t), v))
    return spark.createDataFrame(rows, "symbol string, ts date, x double")


def test_bar_no_matches_row_number(spark):
    df = panel(spark, [1, 5, 400, 999])
    got = with_bar_no(df, bucket_seconds=86400 * 50).toPandas()
    exp = df.withColumn("e", F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).toPandas()
    m = got.merge(exp, on=["symbol", "ts"])
    assert len(m) == len(exp) and (m["bar_no"] == m["e"]).all()


def test_linear_recurrence_block_edges(spark):
    lengths = [1, B - 1, B, B + 1, 2 * B + 1, 3 * B + 7]
    df = with_bar_no(panel(spark, lengths, seed=1)).fillna(0.0)
    out = linear_recurrence(df, {"y": (Q, F.col("x"))}).toPandas()
    for sym, g in out.groupby("symbol"):
        g = g.sort_values("bar_no")
        y, ref = 0.0, []
        for v in g["x"]:
            y = Q * y + v
            ref.append(y)
        assert np.allclose(g["y"].to_numpy(), ref, rtol=1e-11, atol=1e-9), sym


def test_over_chunks_equals_plain_window(spark, small_chunks):
    df = with_bar_no(panel(spark, [3, 16, 17, 50, 101], seed=2))

    def fn(d, w):
        fr = w.rowsBetween(-4, 0)
        return d.withColumns({"lag3": F.lag("x", 3).over(w), "lead2": F.lead("x", 2).over(w),
                              "s5": F.sum("x").over(fr), "c5": F.count("x").over(fr)})
    got = over_chunks(df, fn, lookback=4, lookahead=2).toPandas().sort_values(["symbol", "bar_no"])
    w = Window.partitionBy("symbol").orderBy("bar_no")
    exp = fn(df, w).toPandas().sort_values(["symbol", "bar_no"])
    assert len(got) == len(exp)
    for c in ("lag3", "lead2", "s5", "c5"):
        a, b = got[c].to_numpy(dtype=float), exp[c].to_numpy(dtype=float)
        assert np.allclose(np.nan_to_num(a, nan=-1e9), np.nan_to_num(b, nan=-1e9)), c


def test_scans_with_nulls(spark, small_chunks):
    df = with_bar_no(panel(spark, [1, 15, 40, 100], seed=3, null_frac=0.4))
    got = carry_next(carry_last(running_sum(df, "x", "cs"), "x", "ff"), "x", "bf").toPandas()
    for sym, g in got.groupby("symbol"):
        g = g.sort_values("bar_no")
        s = g["x"].astype(float)
        assert np.allclose(g["cs"], s.fillna(0).cumsum())
        assert np.allclose(np.nan_to_num(g["ff"].astype(float), nan=-1), np.nan_to_num(s.ffill(), nan=-1))
        assert np.allclose(np.nan_to_num(g["bf"].astype(float), nan=-1), np.nan_to_num(s.bfill(), nan=-1))
