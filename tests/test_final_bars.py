"""Append-mode bars: every window once, indicators carried over batches equal
the batch operators, replays change nothing."""

import datetime as dt
import os
import random

import pytest

from candleflow.operators import indicators as I
from candleflow.plans.series import with_bar_no
from candleflow.sources.store import TableStore
from candleflow.streaming import final_bars as S

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
T0 = dt.datetime(2024, 1, 1)


def put(folder, n, rows):
    import pandas as pd
    import pyarrow as pa
    import pyarrow.parquet as pq

    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    path = folder / f"events-{n}.parquet"
    pq.write_table(pa.Table.from_pandas(pdf, preserve_index=False), str(path), coerce_timestamps="us")
    os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))


def test_several_files_with_late_rows_equal_the_batch(spark, tmp_path):
    rnd, folder = random.Random(3), tmp_path / "in"
    folder.mkdir()
    events = [(i, T0 + dt.timedelta(minutes=12 * i), 1, rnd.choice(["view", "click"]), 50 + 10 * rnd.random(), "")
              for i in range(300)]
    cuts = [events[:120], events[120:200], events[200:260], events[260:]]
    cuts[1] = cuts[1] + [cuts[1][3]]  # a repeat
    cuts[2] = cuts[2] + [(9001, T0 + dt.timedelta(minutes=5), 1, "view", 1.0, "")]  # far too late
    for n, rows in enumerate(cuts):
        put(folder, n, rows)
    store = TableStore(spark, str(tmp_path / "store"))
    run = lambda: S.run_final_bar_stream(spark, str(folder), store, str(tmp_path / "ckpt"), files="events-*.parquet")
    got = {(r["symbol"], r["ts"]): r for r in run().collect()}
    # the batch operators over the same events, cut where windows were final
    df = spark.createDataFrame(events, SCHEMA)
    from candleflow.streaming.bars_stream import stream_bar_aggregate
    bars = with_bar_no(stream_bar_aggregate(df))
    wanted = S.OUT
    want = {(r["symbol"], r["ts"]): r for r in I.recursive_indicators(
        I.recursive_inputs(bars, wanted), wanted=wanted).collect()}
    assert len(got) > 80 and set(got) <= set(want)
    last = max(ts for _, ts in got)
    assert {k for k in want if k[1] <= last} == set(got)  # nothing final is missing
    for k, r in got.items():
        for c in [*S.BAR_COLS[2:], *S.OUT]:
            assert (r[c] is None) == (want[k][c] is None), (k, c)
            assert r[c] is None or r[c] == pytest.approx(want[k][c], rel=1e-9), (k, c)
    state = {r["symbol"]: r["n"] for r in store.load("final_bars_state").collect()}
    assert sum(state.values()) == len(got)
    before = store._versions("final_bars")
    assert {(r["symbol"], r["ts"]) for r in run().collect()} == set(got) and store._versions("final_bars") == before


def test_a_batch_that_broke_off_between_its_two_writes(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path / "store"))
    bars = lambda a, b: spark.createDataFrame(
        [("A", T0 + dt.timedelta(hours=i), 1.0 + i, 3.0 + i, 0.5 + i, 2.0 + i % 5, 1.0) for i in range(a, b)],
        "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    S.apply_batch(store, "t", bars(0, 20), 0)
    upsert = TableStore.upsert

    def breaks(self, name, *a, **k):
        if name == "t_state":
            raise OSError("lost")
        return upsert(self, name, *a, **k)

    monkeypatch.setattr(TableStore, "upsert", breaks)
    with pytest.raises(OSError):
        S.apply_batch(store, "t", bars(20, 40), 1)
    monkeypatch.setattr(TableStore, "upsert", upsert)
    S.apply_batch(store, "t", bars(20, 40), 1)
    S.apply_batch(store, "t", bars(20, 40), 1)  # replayed once more
    S.apply_batch(store, "t", bars(40, 41), 2)
    whole = TableStore(spark, str(tmp_path / "whole"))
    S.apply_batch(whole, "t", bars(0, 41), 0)
    rows = lambda s: sorted(map(tuple, s.load("t").collect()))
    assert rows(store) == rows(whole) and store.load("t_state").first()["n"] == 41
