"""Edge series: empty / short series, exact window lengths, flat prices,
zero volume, predictions without bars."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from candleflow.operators import indicators as I
from candleflow.operators import outcomes as O
from candleflow.plans.series import with_bar_no

D0 = dt.date(2010, 1, 4)


def bars(spark, spec):
    """spec: {symbol: [(open, high, low, close, volume), ...]}"""
    rows = [(s, D0 + dt.timedelta(days=i), *map(float, b)) for s, bs in spec.items() for i, b in enumerate(bs)]
    df = spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, "
                                     "close double, volume double")
    return with_bar_no(df)


def test_full_window_rule(spark):
    spec = {"K1": [(1, 2, 1, 1.5, 1)] * 19, "K": [(1, 2, 1, 1.5, 1)] * 20, "ONE": [(1, 1, 1, 1, 1)]}
    out = I.with_windows(bars(spark, spec), [I.sma_cols, I.daily_return_cols, I.rolling_vol_cols], 60)
    r = {s: out.filter(F.col("symbol") == s).orderBy("bar_no").collect() for s in spec}
    assert all(x.sma20 is None for x in r["K1"])
    assert [x.sma20 is None for x in r["K"]] == [True] * 19 + [False]
    assert r["ONE"][0].ret is None and r["ONE"][0].vol_roll5 is None


def test_flat_prices_and_zero_volume(spark):
    spec = {"F": [(5, 5, 5, 5, 0)] * 30}
    b = bars(spark, spec)
    out = I.with_windows(b, [I.stoch_k_cols, I.cci_cols, I.bollinger_cols, I.cmf_cols], 20).orderBy("bar_no").collect()
    last = out[-1]
    assert last.stoch_k is None and last.cci is None and last.bb_pband is None
    assert last.adosc is None            # 0 / 0 money flow
    rec = I.recursive_indicators(I.recursive_inputs(b)).orderBy("bar_no").collect()
    assert rec[12].rsi is None and rec[13].rsi == 100.0      # no losses -> 100
    assert rec[12].atr is None and rec[13].atr == 0.0


def test_outcome_edges(spark):
    b = bars(spark, {"A": [(1, 1, 1, c, 1) for c in (10, 11, 12, 13, 14)]}).drop("bar_no")
    preds = spark.createDataFrame([
        ("A", D0, 1, 0.8, 10, None),                          # entry from bar close
        ("A", D0 + dt.timedelta(days=3), 1, 0.8, 10, 13.0),   # no bar 10 days later -> open
        ("A", D0 - dt.timedelta(days=9), 0, 0.6, 10, None),   # no bar, no entry -> open
    ], "symbol string, ts date, prediction int, confidence double, horizon_days int, entry_price double")
    out = {r.date: r for r in O.prediction_outcomes(preds, b, horizon_days=2).collect()}
    first = out[D0]
    assert first.entry_price == 10.0 and first.exit_price == 12.0 and first.status == "closed"
    assert first.correct is True and first.pnl == 2.0
    assert out[D0 + dt.timedelta(days=3)].status == "open"
    assert out[D0 - dt.timedelta(days=9)].status == "open"
    assert out[D0 - dt.timedelta(days=9)].entry_price is None


def test_dedupe_keeps_last_arrival(spark):
    df = spark.createDataFrame([("A", D0, 1, 0.7, 1), ("A", D0, 0, 0.9, 2), ("B", D0, 1, 0.5, 1)],
                               "symbol string, ts date, prediction int, confidence double, arrival int")
    got = {r.symbol: r for r in O.dedupe_last(df, ["symbol", "ts"], "arrival").collect()}
    assert got["A"].prediction == 0 and got["A"].confidence == 0.9 and got["B"].prediction == 1


@pytest.mark.parametrize("n", [3, 4, 10])
def test_psar_short_series(spark, n):
    spec = {"P": [(i, i + 1, i - 1, i + 0.5, 1) for i in range(10, 10 + n)]}
    out = I.psar(bars(spark, spec)).orderBy("bar_no").collect()
    assert len(out) == n and out[0].psar == out[0].close and out[1].psar == out[1].close
