"""Market structure: hand-worked series, and properties that hold for any
series (random prices with many ties, several chunks per series)."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleflow.operators import structure as M
from candleflow.plans.series import with_bar_no

DAY = dt.date(2001, 1, 1)
SCHEMA = "symbol string, ts date, high double, low double, close double"


def frame(spark, series):
    rows = [(s, DAY + dt.timedelta(days=i), float(h), float(low), float(c))
            for s, bars in series.items() for i, (h, low, c) in enumerate(bars)]
    return with_bar_no(spark.createDataFrame(rows, SCHEMA))


def path(*turns, step=6):
    """A price that runs straight between turning points, ``step`` bars each;
    every bar is one point wide."""
    price = [float(turns[0])]
    for a, b in zip(turns, turns[1:]):
        price += [a + (b - a) * (i + 1) / step for i in range(step)]
    return [(p + 0.5, p - 0.5, p) for p in price]


def table(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("symbol", "sw_no").collect()]


def test_hand_worked_up_trend_and_reversal(spark):
    # lows and highs rise, then a lower high and a lower low
    bars = frame(spark, {"S": path(50, 60, 54, 70, 58, 66, 48, 62)})
    sw = M.labelled_swings(bars)
    assert table(sw, "price", "swing_type", "label", "seq_count", "seq_dir", "trend") == [
        (60.5, "high", "H", 0, None, "neutral"),
        (53.5, "low", "L", 0, None, "neutral"),
        (70.5, "high", "HH", 1, "long", "neutral"),
        (57.5, "low", "HL", 2, "long", "up"),
        (66.5, "high", "LH", 1, "short", "up"),
        (47.5, "low", "LL", 2, "short", "down"),
    ]
    # the first labelled swing only sets the state; the low under 57.5 turns it
    sig = M.structure_signals(bars, sw).collect()
    assert [(r.type, r.direction, r.level) for r in sig] == [("choch", "short", 57.5)]
    # first close below the level on the way from 66 (bar 30) to 48: 66 - 3 i < 57.5 at i = 3
    assert sig[0].ts == DAY + dt.timedelta(days=33) and sig[0].price == 57.0


def test_hand_worked_break_of_structure(spark):
    bars = frame(spark, {"S": path(50, 60, 54, 70, 58, 82, 64, 70)})
    sig = M.structure_signals(bars, M.labelled_swings(bars)).collect()
    # 58 -> 82 in steps of 4: the first close above 70.5 is 74 at the fourth bar
    assert [(r.type, r.direction, r.level, r.price, (r.ts - DAY).days) for r in sig] == [("bos", "long", 70.5, 74.0, 28)]


def test_equal_neighbours_are_no_swing(spark):
    flat = [(10.0, 9.0, 9.5)] * 30
    twin = path(10, 20, 10)
    twin[6] = twin[5] = (20.5, 19.0, 20.0)  # two bars share the top
    assert M.swing_points(frame(spark, {"F": flat, "T": twin})).count() == 0


#: state after a label, given the state before it; others leave it as it is
MOVES = {"HH": "up", "LL": "down"}
SIGNALS = {("up", "HH"): ("bos", "long"), ("up", "LL"): ("choch", "short"),
           ("down", "LL"): ("bos", "short"), ("down", "HH"): ("choch", "long")}


@pytest.mark.parametrize("seed", [0, 1])
def test_properties_on_random_series(spark, seed, small_chunks):
    rng = np.random.default_rng(seed)
    series = {}
    for s in range(5):
        n = int(rng.integers(5, 160))
        high = rng.integers(10, 20, n)
        low = high - rng.integers(0, 4, n)
        series[f"S{s}"] = list(zip(high, low, low + rng.integers(0, 2, n) * (high - low)))
    bars = frame(spark, series)
    points = M.swing_points(bars).toPandas()
    swings = M.labelled_swings(bars).toPandas()
    signals = M.structure_signals(bars, M.labelled_swings(bars)).toPandas()
    order = M.SWING_ORDER
    for name, rows in series.items():
        at = lambda ts: (ts - DAY).days  # noqa: E731, B023
        side = {"high": [r[0] for r in rows], "low": [-r[1] for r in rows]}
        mine = points[points.symbol == name]
        found = {(at(t), k) for t, k in zip(mine.ts, mine.swing_type)}
        for kind, v in side.items():  # a point is the only largest value of its 11 bars
            for i in range(len(v)):
                around = v[max(0, i - order):i] + v[i + 1:i + order + 1]
                inside = order <= i < len(v) - order
                assert ((i, kind) in found) == (inside and all(v[i] > x for x in around))
        sw = swings[swings.symbol == name].sort_values("sw_no")
        kinds = list(sw.swing_type)
        assert all(a != b for a, b in zip(kinds, kinds[1:]))  # they alternate
        last, state, run, sig = {}, None, 0, []
        before, trend = None, "neutral"
        for r in sw.itertuples():
            assert (at(r.ts), r.swing_type) in found
            prev = last.get(r.swing_type)
            want = r.swing_type[0].upper() if prev is None else ("H" if r.price > prev else "L") + r.swing_type[0].upper()
            assert r.label == want
            up = {"HH": True, "HL": True, "LH": False, "LL": False}.get(r.label)
            run = 0 if up is None else run + 1 if up == before else 1
            assert r.seq_count == run
            if run >= 2:
                trend = "up" if up else "down"
            assert r.trend == trend
            if up is not None:
                if state is None:
                    state = "up" if up else "down"
                else:
                    if (state, r.label) in SIGNALS:
                        sig.append((*SIGNALS[state, r.label], prev))
                    state = MOVES.get(r.label, state)
            before, last[r.swing_type] = up, r.price
        mine = signals[signals.symbol == name]
        assert sorted(zip(mine.type, mine.direction, mine.level)) == sorted(sig)
        for r in mine.itertuples():  # a signal stands at a close beyond its level, or at the swing itself
            close = rows[at(r.ts)][2]
            beyond = close > r.level if r.direction == "long" else close < r.level
            assert beyond and close == r.price or (at(r.ts), "high" if r.direction == "long" else "low") in found


def test_every_clean_swing_is_the_extreme_of_its_run(spark):
    rng = np.random.default_rng(5)
    price = np.cumsum(rng.normal(0, 1, 400)) + 100
    bars = frame(spark, {"R": [(p + 0.3, p - 0.3, p) for p in price]})
    points = M.swing_points(bars).orderBy("ts", F.desc(F.col("swing_type") == "high")).collect()
    runs = []
    for r in points:
        if runs and runs[-1][-1].swing_type == r.swing_type:
            runs[-1].append(r)
        else:
            runs.append([r])
    want = [max(run, key=lambda r: (r.price if r.swing_type == "high" else -r.price)).ts for run in runs]
    assert [r.ts for r in M.labelled_swings(bars).orderBy("sw_no").collect()] == want
