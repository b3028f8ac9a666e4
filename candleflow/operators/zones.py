"""Price zones and when they are entered again (D5): fair-value gaps and order
blocks with their lifetimes.

"The first bar after b whose low is at or below L" is answered for all zones at
once without a range join: per series the values are cut into blocks of
``FAN`` bars, each with its minimum, those into blocks of ``FAN`` minima, and so
on.  A probe looks at the rest of its block, then climbs: at every level it
meets one array, by (series, block), until some entry is low enough; then it
descends to the bar.  Highs are searched as lows of their negatives.  Levels
are as many as the logarithm of the longest series to the base ``FAN``.

Defined cases: NULL lows or highs are never low (high) enough; a zone at the
last bar has no bar after it; a series without bars has no zones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleflow.operators.indicators import fair_value_gaps
from candleflow.operators.structure import SWING_ORDER, swing_points
from candleflow.plans.series import BAR, KEY
from candleflow.session import materialize

FAN = 64
SIDE = "_side"


def first_at_or_below(values: DataFrame, probes: DataFrame, fan: int = FAN) -> DataFrame:
    """``values``: (symbol, _side, bar_no, v), bar_no from 0 without holes;
    ``probes``: (symbol, _side, pid, start, level) -> (pid, at): the first bar_no
    >= start with v <= level; probes without one are left out."""
    keys = [KEY, SIDE]
    last = values.agg(F.max(BAR)).first()[0]
    if last is None:
        return probes.select("pid", F.lit(None).cast("long").alias("at")).limit(0)
    # level 0: the values of each block; level k: the minima of blocks of level k - 1
    levels, now, size = [], values.select(*keys, F.col(BAR).alias("_i"), "v"), last + 1
    while True:
        blocks = now.groupBy(*keys, F.floor(F.col("_i") / fan).alias("_b")).agg(
            F.array_sort(F.collect_list(F.struct(F.pmod("_i", F.lit(fan)).cast("int").alias("j"), "v"))).alias("_a"))
        levels.append(materialize(blocks, "blocks"))
        size = -(-size // fan)
        if size <= 1:
            break
        low = F.array_min(F.transform("_a", lambda e: e["v"]))
        now = levels[-1].select(*keys, F.col("_b").alias("_i"), low.alias("v"))

    def look(rows: DataFrame, level: int, how: str) -> DataFrame:
        """The first entry of each row's block from ``_p`` on that is low enough."""
        found = F.array_min(F.transform("_a", lambda e: F.when(
            (e["j"] >= F.pmod("_p", F.lit(fan))) & (e["v"] <= F.col("level")), e["j"])))
        met = rows.withColumn("_b", F.floor(F.col("_p") / fan)).join(levels[level], [*keys, "_b"], how)
        return met.withColumn("_j", found).drop("_a")

    open_ = probes.select(*keys, "pid", "level", F.col("start").alias("_p"))
    hits = []
    for level in range(len(levels)):  # a block past the end of the series ends the search
        met = materialize(look(open_, level, "inner"), "probes")
        here = F.col("_j").isNotNull()
        hits.append(met.where(here).select(*keys, "pid", "level", (F.col("_b") * fan + F.col("_j")).alias("_p")))
        open_ = met.where(~here).select(*keys, "pid", "level", (F.col("_b") + 1).alias("_p"))
    down = hits[-1]
    for level in range(len(levels) - 2, -1, -1):
        met = look(down.withColumn("_p", F.col("_p") * fan), level, "inner")
        down = met.select(*keys, "pid", "level", (F.col("_b") * fan + F.col("_j")).alias("_p")).unionByName(hits[level])
    return down.select("pid", F.col("_p").alias("at"))


def zone_lifetimes(bars: DataFrame, zones: DataFrame) -> DataFrame:
    """``zones`` (symbol, ..., direction, zone_low, zone_high, _known: the bar
    that makes the zone known) with ``first_touch`` and ``filled``: the time of
    the first later bar that trades into the zone, and of the first that
    trades through it.  A bullish zone lies below the price, a bearish one above."""
    zones = materialize(zones.withColumn("_zid", F.monotonically_increasing_id()), "zones")
    bull = F.col("direction") == "bullish"
    values = bars.select(KEY, BAR, F.explode(F.array(
        F.struct(F.lit(0).alias(SIDE), F.col("low").alias("v")),
        F.struct(F.lit(1).alias(SIDE), (-F.col("high")).alias("v")))).alias("e")).select(KEY, BAR, "e.*")
    near = F.when(bull, F.col("zone_high")).otherwise(-F.col("zone_low"))
    far = F.when(bull, F.col("zone_low")).otherwise(-F.col("zone_high"))
    probes = zones.select(KEY, F.when(bull, 0).otherwise(1).alias(SIDE), (F.col("_known") + 1).alias("start"), F.explode(
        F.array(F.struct((F.col("_zid") * 2).alias("pid"), near.alias("level")),
                F.struct((F.col("_zid") * 2 + 1).alias("pid"), far.alias("level")))).alias("e")) \
        .select(KEY, SIDE, "start", "e.pid", "e.level")
    at = first_at_or_below(values, probes)
    at = at.groupBy(F.shiftright("pid", 1).alias("_zid")).agg(
        F.max(F.when(F.col("pid") % 2 == 0, F.col("at"))).alias("_t"),
        F.max(F.when(F.col("pid") % 2 == 1, F.col("at"))).alias("_f"))
    out = zones.join(at, "_zid", "left")
    times = bars.select(F.col(KEY).alias("_k"), F.col(BAR).alias("_n"), F.col("ts").alias("_ts"))
    for bar, name in (("_t", "first_touch"), ("_f", "filled")):
        some = out.where(F.col(bar).isNotNull()).join(times, (F.col(KEY) == F.col("_k")) & (F.col(bar) == F.col("_n")), "left")
        none = out.where(F.col(bar).isNull()).withColumn("_ts", F.lit(None).cast(bars.schema["ts"].dataType))
        out = some.drop("_k", "_n").unionByName(none).withColumnRenamed("_ts", name)
    return out.drop("_zid", "_known", "_t", "_f")


def gap_lifetimes(bars: DataFrame) -> DataFrame:
    """Fair-value gaps, known with the bar after their middle bar, and when
    they were first entered and filled."""
    gaps = fair_value_gaps(bars).join(bars.select(KEY, "ts", BAR), [KEY, "ts"])
    zones = gaps.select(KEY, "ts", "direction", F.col("gap_low").alias("zone_low"), F.col("gap_high").alias("zone_high"),
                        (F.col(BAR) + 1).alias("_known"))
    return zone_lifetimes(bars, zones)


def order_blocks(bars: DataFrame, order: int = SWING_ORDER) -> DataFrame:
    """Demand and supply zones at swing points: from a swing low up to the top
    of its candle's body (bullish), from the bottom of a swing high's body up to
    the high (bearish); known ``order`` bars later."""
    swings = swing_points(bars, order).select(KEY, "ts", "swing_type")
    rows = swings.join(bars.select(KEY, "ts", BAR, "open", "high", "low", "close"), [KEY, "ts"])
    low = F.col("swing_type") == "low"
    zones = rows.select(
        KEY, "ts", F.when(low, "bullish").otherwise("bearish").alias("direction"),
        F.when(low, F.col("low")).otherwise(F.least("open", "close")).alias("zone_low"),
        F.when(low, F.greatest("open", "close")).otherwise(F.col("high")).alias("zone_high"),
        (F.col(BAR) + order).alias("_known"))
    return zone_lifetimes(bars, zones)
