"""Final bars and running indicators as a stream (append mode).

A window is emitted once, when the watermark has passed its end; later rows
are dropped by the aggregation.  Each micro-batch of final bars goes on from
the state that the batch before it left: per series the number of bars, the
last close, and the running EMA and Wilder values, one row a series in a table
of its own.  A batch writes its rows first and its state second, both under
the batch's number, so a batch that is run again after a failure writes only
what is missing, from the same state, and the tables end the same.

The numbers are those of the batch operators over the emitted bars: EMA seeded
by the first close and shown from its n-th bar, RSI by Wilder averages of moves
from the first bar, ATR seeded by the mean of the first 14 true ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleflow.operators.indicators import ATR_WINDOW, EMA_WINDOWS, RSI_WINDOW
from candleflow.session import materialize
from candleflow.sources.store import TableStore
from candleflow.streaming.bars_stream import event_stream, stream_bar_aggregate

BAR_COLS = ["symbol", "ts", "open", "high", "low", "close", "volume"]
OUT = [*(f"ema_{k}" for k in EMA_WINDOWS), "rsi", "atr"]
#: what a series carries from bar to bar
STATE = ["n", "prev_close", *(f"e{k}" for k in EMA_WINDOWS), "up", "down", "tr"]


def advance(state: dict, bar) -> dict:
    """One bar further: ``state`` is changed, the shown values are returned."""
    n, prev, close = state["n"], state["prev_close"], bar.close
    for k in EMA_WINDOWS:
        a = 2.0 / (k + 1)
        state[f"e{k}"] = close if n == 0 else a * close + (1 - a) * state[f"e{k}"]
    move, a = (close - prev if n else 0.0), 1.0 / RSI_WINDOW
    for name, x in (("up", max(move, 0.0)), ("down", max(-move, 0.0))):
        state[name] = x if n == 0 else a * x + (1 - a) * state[name]
    spread = bar.high - bar.low
    true_range = spread if n == 0 else max(spread, abs(bar.high - prev), abs(bar.low - prev))
    # until the seed is complete the state holds the sum of true ranges
    if n < ATR_WINDOW:
        state["tr"] = (state["tr"] if n else 0.0) + true_range
        if n == ATR_WINDOW - 1:
            state["tr"] /= ATR_WINDOW
    else:
        state["tr"] = ((ATR_WINDOW - 1) * state["tr"] + true_range) / ATR_WINDOW
    state["n"], state["prev_close"] = n + 1, close
    shown = {f"ema_{k}": state[f"e{k}"] if n >= k - 1 else None for k in EMA_WINDOWS}
    shown["rsi"] = None if n < RSI_WINDOW - 1 else 100.0 if state["down"] == 0 else \
        100.0 - 100.0 / (1.0 + state["up"] / state["down"])
    shown["atr"] = state["tr"] if n >= ATR_WINDOW - 1 else None
    return shown


def with_running_indicators(bars: DataFrame, state: DataFrame) -> DataFrame:
    """New bars of each series (all later than those the state has seen) with
    the indicators and the state after each bar.  A group is one series' bars
    of one micro-batch."""
    def step(new, old):
        import pandas as pd

        now = {k: v for k, v in old.iloc[0].items() if k in STATE} if len(old) else dict.fromkeys(STATE, 0.0)
        now["n"] = int(now["n"])
        rows = []
        for bar in new.sort_values("ts").itertuples(index=False):
            shown = advance(now, bar)
            rows.append({**bar._asdict(), **shown, **now})
        return pd.DataFrame(rows, columns=[*BAR_COLS, *OUT, *STATE])

    doubles = ", ".join(f"{c} double" for c in ["open", "high", "low", "close", "volume", *OUT])
    schema = f"symbol string, ts timestamp_ntz, {doubles}, n long, " + ", ".join(f"{c} double" for c in STATE[1:])
    return bars.select(*BAR_COLS).groupBy("symbol").cogroup(state.groupBy("symbol")).applyInPandas(step, schema)


def state_schema() -> str:
    return "symbol string, n long, " + ", ".join(f"{c} double" for c in STATE[1:])


def apply_batch(store: TableStore, name: str, batch: DataFrame, batch_id: int) -> None:
    """One micro-batch of final bars: rows, then state, each at most once."""
    writer, states = f"stream_{name}", f"{name}_state"
    if (store.applied(states, writer) or 0) > batch_id or store.applied(states, writer) == batch_id:
        return
    try:
        state = store.load(states)
    except FileNotFoundError:
        state = store.spark.createDataFrame([], state_schema())
    named = state.join(batch.select("symbol").distinct(), "symbol", "left_semi")
    rows = materialize(with_running_indicators(batch, named), "final_bars")
    store.upsert(name, rows.select(*BAR_COLS, *OUT), ["symbol", "ts"], writer=writer, batch=batch_id)
    last = rows.groupBy("symbol").agg(F.max_by(F.struct(*STATE), F.col("n")).alias("s")).select("symbol", "s.*")
    store.upsert(states, last, ["symbol"], writer=writer, batch=batch_id)


def run_final_bar_stream(spark: SparkSession, sf_dir: str, store: TableStore, checkpoint: str,
                         name: str = "final_bars", files: str = "events.parquet") -> DataFrame:
    """Processes everything available and returns the table of final bars;
    windows that the watermark has not passed wait for later events."""
    bars = stream_bar_aggregate(event_stream(spark, sf_dir, files=files))
    q = (bars.writeStream.outputMode("append")
         .foreachBatch(lambda batch, batch_id: apply_batch(store, name, batch, batch_id))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    try:
        return store.load(name)
    except FileNotFoundError:  # no window is final yet
        return spark.createDataFrame([], "symbol string, ts timestamp_ntz, " + ", ".join(
            f"{c} double" for c in [*BAR_COLS[2:], *OUT]))
