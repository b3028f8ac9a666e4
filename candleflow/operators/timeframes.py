"""Market structure on several timeframes at once.

Bars are partial states that merge: the first and the last trade with their
order, the extremes and the volume.  Trades are aggregated once, into the
smallest width; every larger width is rolled up from the one before it.

The trend of a timeframe changes when a swing is *confirmed*, ``order`` bars
of that timeframe after it, at the end of that bar.  The changes of all
timeframes and the ends of the small bars form one ordered series, over which
all trends are carried together.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleflow.operators import structure as M
from candleflow.plans.series import BAR, KEY, carry_last, with_bar_no
from candleflow.session import materialize


@dataclass(frozen=True)
class Timeframe:
    name: str
    width: str  # an interval that divides the next one
    order: int  # swing sensitivity


#: fixed values: widths and swing orders of the documented setting
TIMEFRAMES = (Timeframe("5m", "5 minutes", 3), Timeframe("15m", "15 minutes", 6), Timeframe("1d", "1 day", 5))


def _merge(states: DataFrame, bucket) -> DataFrame:
    return states.groupBy(KEY, bucket.alias("ts")).agg(
        F.min_by("open", "first_seq").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last_seq").alias("close"), F.sum("volume").alias("volume"),
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


def rolled_bars(trades: DataFrame, frames=TIMEFRAMES) -> dict[str, DataFrame]:
    """Bars of every timeframe, numbered; ``trades`` as from the bar sources."""
    price = F.col("price")
    states = trades.select(KEY, "ts", price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"),
                           F.col("qty").alias("volume"), F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"))
    out = {}
    for frame in frames:
        states = materialize(_merge(states, F.window("ts", frame.width).getField("start")), f"bars_{frame.name}")
        out[frame.name] = materialize(with_bar_no(states.drop("first_seq", "last_seq")), f"bars_{frame.name}")
    return out


def confirmed_trends(bars: DataFrame, frame: Timeframe) -> DataFrame:
    """(symbol, known, trend): the trend from the end of the bar on that
    confirms a swing; of two swings confirmed at once the later counts."""
    swings = M.labelled_swings(bars, frame.order).join(bars.select(KEY, "ts", BAR), [KEY, "ts"]) \
        .select(KEY, (F.col(BAR) + frame.order).alias(BAR), M.SW, "trend")
    ends = bars.select(KEY, BAR, (F.col("ts") + F.expr(f"INTERVAL {frame.width}")).alias("known"))
    return swings.join(ends, [KEY, BAR]).groupBy(KEY, "known").agg(F.max_by("trend", M.SW).alias("trend"))


def timeframe_status(trades: DataFrame, frames=TIMEFRAMES) -> DataFrame:
    """One row per bar of the smallest timeframe: its time, the trend of every
    timeframe as known at its end, and a summary: the trend of the largest, with
    ``_wait`` where a smaller one does not follow it."""
    bars = rolled_bars(trades, frames)
    names = [f.name for f in frames]
    small = frames[0]
    events = None
    for frame in frames:
        own = confirmed_trends(bars[frame.name], frame).select(
            KEY, "known", *[(F.col("trend") if n == frame.name else F.lit(None).cast("string")).alias(f"_{n}")
                            for n in names])
        events = own if events is None else events.unionByName(own)
    # one row per time, so that (time, kind) orders the series
    events = events.groupBy(KEY, "known").agg(*[F.max(f"_{n}").alias(f"_{n}") for n in names])
    events = events.withColumns({"kind": F.lit(0), "bar_ts": F.lit(None).cast("timestamp_ntz")})
    ends = bars[small.name].select(
        KEY, (F.col("ts") + F.expr(f"INTERVAL {small.width}")).alias("known"),
        *[F.lit(None).cast("string").alias(f"_{n}") for n in names], F.lit(1).alias("kind"), F.col("ts").alias("bar_ts"))
    both = materialize(with_bar_no(events.unionByName(ends).withColumnRenamed("known", "ts"), tiebreak=["kind"]), "status")
    carried = carry_last(both, [f"_{n}" for n in names]).where("kind = 1")
    trend = {n: F.coalesce(F.col(f"_{n}"), F.lit("neutral")) for n in names}
    main = trend[names[-1]]
    follow = F.lit(True)
    for n in names[:-1]:
        follow = follow & (trend[n] == main)
    word = F.when(main == "up", "bullish").when(main == "down", "bearish")
    status = F.when(word.isNull(), "neutral").when(follow, word).otherwise(F.concat(word, F.lit("_wait")))
    return carried.select(KEY, F.col("bar_ts").alias("ts"), *[trend[n].alias(f"trend_{n}") for n in names],
                          status.alias("status"))
