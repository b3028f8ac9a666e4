"""Bar sources: trade/event tables -> OHLCV bars.

The reference downloads daily bars; here bars are *built* from a trade table
with one grouped aggregation, which Spark plans as a partial (map-side)
aggregation followed by one shuffle on ``(symbol, bucket)``.  A symbol that
holds a third of all trades is therefore pre-aggregated on every mapper
before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleflow.plans.series import with_bar_no
from candleflow.session import materialize

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _digits(*parts):
    """Non-negative integers of at most the given digits, one after another.
    A longer one is an error: cut, it would be put in a wrong order."""
    def padded(c, n: int):
        text = (F.col(c) if isinstance(c, str) else c).cast("string")
        long = F.concat(text, F.lit(f" has more than {n} digits"))
        return F.when(F.length(text) > n, F.raise_error(long).cast("string")) \
                .otherwise(F.lpad(text, n, "0"))

    return F.concat(*[padded(c, n) for c, n in parts]).cast("decimal(38,0)")


def trades_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """``(symbol, ts, price, qty, seq)``: one trade per line item.

    symbol = return flag || line status; ts = ship day; price = extended
    price / quantity.  ``seq`` orders trades inside a bar: order key, line
    number, part and supplier (unique per ship day in the driver data) as the
    digits of one decimal, a fixed-width value that hash aggregation can hold.
    """
    li = lineitem.select(*LINEITEM_COLS)
    return li.select(
        F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("symbol"),
        F.to_date("l_shipdate").alias("ts"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        F.col("l_quantity").cast("double").alias("qty"),
        _digits(("l_orderkey", 14), ("l_linenumber", 2), ("l_partkey", 11), ("l_suppkey", 11)).alias("seq"))


def trades_from_events(events: DataFrame) -> DataFrame:
    """``(symbol, ts, price, qty, seq)`` from the event stream table."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts"),
        F.col("value").cast("double").alias("price"),
        F.lit(1.0).alias("qty"),
        # 20 digits of time and 18 of the id
        _digits((F.date_format("ts", "yyyyMMddHHmmssSSSSSS"), 20), ("event_id", 18)).alias("seq"))


def ohlcv(trades: DataFrame, bucket=None) -> DataFrame:
    """Group trades into bars; ``bucket`` maps a trade to its bar start.

    open/close are the first/last trade by ``seq``; volume is the quantity sum.
    """
    ts = F.col("ts") if bucket is None else bucket
    return (trades.groupBy(F.col("symbol"), ts.alias("ts"))
            .agg(F.min_by("price", "seq").alias("open"),
                 F.max("price").alias("high"),
                 F.min("price").alias("low"),
                 F.max_by("price", "seq").alias("close"),
                 F.sum("qty").alias("volume")))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily OHLCV bars from ``lineitem`` (6 series)."""
    return ohlcv(trades_from_lineitem(read_table(spark, sf_dir, "lineitem")))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly OHLCV bars from ``events`` (5 series)."""
    trades = trades_from_events(read_table(spark, sf_dir, "events"))
    # window() keeps TIMESTAMP_NTZ: bar starts do not depend on the session time zone
    return ohlcv(trades, F.window("ts", "1 hour").getField("start"))


def indexed_bars(spark: SparkSession, sf_dir: str, hourly: bool = False,
                 persist: bool = True) -> DataFrame:
    """Bars plus the per-series position ``bar_no`` (input of ordered ops).

    With ``persist`` the indexed bar table is written once to the shared
    checkpoint folder, so the trade scan and bar aggregation run once no
    matter how many branches (carries, joins) the ordered plan has.
    """
    bars = hourly_bars(spark, sf_dir) if hourly else daily_bars(spark, sf_dir)
    indexed = with_bar_no(bars)
    return materialize(indexed, "bars") if persist else indexed


def newest_day(spark: SparkSession, sf_dir: str):
    """Day of the newest trade: one narrow column, answered from statistics
    where the files have them, without building bars."""
    return read_table(spark, sf_dir, "lineitem").agg(F.max(F.to_date("l_shipdate"))).first()[0]


def recent(df: DataFrame, months: int, ref_ts=None, ts: str = "ts") -> DataFrame:
    """Rows with ``ts >= ref - months`` (``ref`` defaults to ``max(ts)``).

    The reference time is a parameter so results are deterministic.  When
    omitted it is fetched as one scalar (a distributed ``max``) and applied
    as a literal filter -- no join against a one-row table.
    """
    if ref_ts is None:
        ref_ts = df.agg(F.max(ts)).first()[0]
    cutoff = F.add_months(F.lit(ref_ts).cast("date"), -months)
    return df.filter(F.col(ts) >= cutoff)
