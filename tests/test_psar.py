"""Chunk-parallel parabolic SAR equals the sequential state machine, both
when chunk boundaries synchronise (large halo) and when they do not (tiny halo, or a
steady trend: chunks run again from the true state, in rounds)."""

import os

import numpy as np
import pytest

from candleflow.operators import indicators as I
from candleflow.sources import bars as S

SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver data not present")
@pytest.mark.parametrize("chunk,halo", [(300, 120), (300, 2)])
def test_chunked_psar_is_exact(spark, chunk, halo):
    bars = S.indexed_bars(spark, SF)
    got = I.psar_values(bars, chunk_bars=chunk, halo=halo).toPandas()
    pdf = bars.select("symbol", "bar_no", "high", "low", "close").toPandas()
    for sym, g in pdf.groupby("symbol"):
        g = g.sort_values("bar_no")
        exp = I._psar_kernel(g["high"].to_numpy(), g["low"].to_numpy(), g["close"].to_numpy())
        mine = got[got.symbol == sym].sort_values("bar_no")
        assert len(mine) == len(g)
        assert np.array_equal(mine["psar"].to_numpy(), exp), sym


@pytest.mark.parametrize("chunk,halo", [(200, 50), (2000, 1024), (10_000, 1024), (3000, 5000)])
def test_steady_trend_and_phantom_chunks(spark, chunk, halo):
    from pyspark.sql import functions as F
    n = 6000  # ends exactly on a chunk edge for most lengths
    price = 100.0 + np.arange(n) * 0.037 + 0.01 * np.sin(np.arange(n))
    if chunk == 200:
        price, n = price[:1000], 1000
    pdf = [("T", i, float(p + 0.2), float(p - 0.2), float(p)) for i, p in enumerate(price)] + [("one", 0, 2.0, 1.0, 1.5)]
    bars = spark.createDataFrame(pdf, "symbol string, bar_no long, high double, low double, close double")
    got = I.psar_values(bars, chunk_bars=chunk, halo=halo).filter(F.col("symbol") == "T").orderBy("bar_no").toPandas()
    exp = I._psar_kernel(price + 0.2, price - 0.2, price)
    assert np.array_equal(got["psar"].to_numpy(), exp) and len(got) == n
