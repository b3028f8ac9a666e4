"""Streaming bar aggregate: duplicates are dropped by event id, results equal
the batch bar builder; the bounded-trigger stream reproduces them."""

import datetime as dt

from pyspark.sql import functions as F

from candleflow.sources import bars as S
from candleflow.streaming.bars_stream import stream_bar_aggregate

T0 = dt.datetime(2024, 1, 1, 9, 0, 0)


def events(spark, dup=False):
    rows = [(i, T0 + dt.timedelta(minutes=7 * i), 1, "click" if i % 2 else "view", float(10 + i), "{}")
            for i in range(40)]
    if dup:
        rows += rows[:10]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                       "value double, props string")


def as_set(df):
    return {tuple(r) for r in df.select("symbol", "ts", "open", "high", "low", "close", "volume").collect()}


def test_duplicates_are_dropped_and_match_batch_bars(spark):
    batch = S.ohlcv(S.trades_from_events(events(spark)), F.window("ts", "1 hour").getField("start"))
    streamed_logic = stream_bar_aggregate(events(spark, dup=True))
    assert as_set(streamed_logic) == as_set(batch)


def test_stream_with_duplicates_equals_batch(spark, tmp_path):
    import uuid

    import pyarrow as pa
    import pyarrow.parquet as pq

    from candleflow.sources.store import TableStore
    from candleflow.streaming.bars_stream import run_bar_stream

    pdf = events(spark, dup=True).toPandas()
    pq.write_table(pa.Table.from_pandas(pdf, preserve_index=False), str(tmp_path / "events.parquet"),
                   coerce_timestamps="us")
    root = str(tmp_path / f"s-{uuid.uuid4().hex}")
    out = run_bar_stream(spark, str(tmp_path), TableStore(spark, f"{root}/store"), f"{root}/ckpt")
    batch = S.ohlcv(S.trades_from_events(events(spark)), F.window("ts", "1 hour").getField("start"))
    assert as_set(out) == as_set(batch)


def test_several_batches_late_rows_and_replay(spark, tmp_path):
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    from candleflow.sources.store import TableStore
    from candleflow.streaming.bars_stream import run_bar_stream

    folder = tmp_path / "in"
    folder.mkdir()

    def put(n, rows):
        pdf = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                          "value double, props string").toPandas()
        path = folder / f"events-{n}.parquet"
        pq.write_table(pa.Table.from_pandas(pdf, preserve_index=False), str(path), coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))

    at = lambda h, m: T0.replace(hour=h, minute=m)
    put(1, [(1, at(9, 5), 1, "view", 10.0, ""), (2, at(10, 0), 1, "view", 11.0, "")])
    # in time for the 9 o'clock bar (the watermark is 9:00), a repeat, and the next bars
    put(2, [(3, at(9, 50), 1, "view", 99.0, ""), (2, at(10, 0), 1, "view", 11.0, ""), (4, at(13, 0), 1, "view", 5.0, "")])
    put(3, [(6, at(14, 30), 1, "view", 7.0, "")])
    # 9:01 comes too late (batches drop rows by the watermark of the batch before)
    put(4, [(5, at(9, 1), 1, "view", 1.0, ""), (7, at(14, 40), 1, "view", 8.0, "")])
    store = TableStore(spark, f"{tmp_path}/store")
    run = lambda: run_bar_stream(spark, str(folder), store, f"{tmp_path}/ckpt", files="events-*.parquet")
    want = {("view", at(9, 0), 10.0, 99.0, 10.0, 99.0, 2.0), ("view", at(10, 0), 11.0, 11.0, 11.0, 11.0, 1.0),
            ("view", at(13, 0), 5.0, 5.0, 5.0, 5.0, 1.0), ("view", at(14, 0), 7.0, 8.0, 7.0, 8.0, 2.0)}
    assert as_set(run()) == want
    assert as_set(run()) == want  # nothing new: the same table
    store.upsert("bars_hourly", store.load("bars_hourly"), ["symbol", "ts"])  # a replayed batch
    assert as_set(store.load("bars_hourly")) == want
