"""Market structure: ATR days, swing points, HH/HL/LH/LL labels, sequences,
trend, zigzag, prevailing state, break of structure / change of character.

The reference walks swings with Python loops.  Here every step is a window
over a per-series position (``bar_no`` over bars, ``sw_no`` over swings) run
through the chunked layout, plus carries for running state:

* swing points: a bar's high is the unique max of the 2*order+1 bars around
  it  <=>  high > max of the ``order`` bars before and after (both present);
* clean-up: runs of same-type swings are islands (run id = running count of
  type changes); each island keeps its extreme, the earliest on ties;
* after clean-up types alternate, so "previous swing of the same type" is
  the swing two positions back;
* prevailing state: set by the first labelled swing, then only HH -> up and
  LL -> down; the state *before* a swing is the carried state one swing back;
* break bar: each bar is assigned to every swing interval
  ``[ts_{i-1}, ts_i]`` that contains it (boundary bars to two) and joined to
  the signal on (symbol, interval) -- an equi-join, no range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleflow.functions.scalar import ratio
from candleflow.plans.series import (BAR, KEY, carry_last, carry_next, over_chunks,
                                     running_sum, with_bar_no)
from candleflow.session import materialize

SWING_ORDER = 5
SW = "sw_no"
BULL = ("HH", "HL")
BEAR = ("LH", "LL")


def atr_days(ind: DataFrame) -> DataFrame:
    """M1: ``atr_ratio`` = (H - L) / ATR14; up day = close >= open."""
    r = ratio(F.col("high") - F.col("low"), F.col("atr"))
    return (ind.withColumn("atr_ratio", r)
            .withColumn("is_up", F.col("close") >= F.col("open"))
            .withColumn("double_atr", F.col("atr_ratio") >= 2.0)
            .withColumn("single_atr", (F.col("atr_ratio") >= 1.0) & (F.col("atr_ratio") < 2.0)))


def swing_points(bars: DataFrame, order: int = SWING_ORDER) -> DataFrame:
    """M3: ``(symbol, ts, price, swing_type)`` for strict local extremes."""
    def fn(d, w):
        before, after = w.rowsBetween(-order, -1), w.rowsBetween(1, order)
        full = F.lag("high", order).over(w).isNotNull() & F.lead("high", order).over(w).isNotNull()
        is_hi = full & (F.col("high") > F.max("high").over(before)) & \
            (F.col("high") > F.max("high").over(after))
        is_lo = full & (F.col("low") < F.min("low").over(before)) & \
            (F.col("low") < F.min("low").over(after))
        return d.withColumn("_hi", is_hi).withColumn("_lo", is_lo)
    flagged = over_chunks(bars.select(KEY, "ts", BAR, "high", "low"), fn, order, order)
    highs = flagged.filter("_hi").select(KEY, "ts", F.col("high").alias("price"),
                                         F.lit("high").alias("swing_type"))
    lows = flagged.filter("_lo").select(KEY, "ts", F.col("low").alias("price"),
                                        F.lit("low").alias("swing_type"))
    return highs.unionByName(lows)


def _type_order():
    # same-date high and low (outside bar): high first
    return F.when(F.col("swing_type") == "high", 0).otherwise(1)


def clean_swings(swings: DataFrame) -> DataFrame:
    """M4: keep the extreme of each run of same-type swings."""
    # written twice on the way: scans join a table with an aggregate of itself,
    # so each unwritten step would double the plan of the one after it
    points = materialize(swings.withColumn("_to", _type_order()), "swing_points")
    idx = materialize(with_bar_no(points, out=BAR, tiebreak=["_to"]), "swing_points")

    def change(d, w):
        prev = F.lag("swing_type", 1).over(w)
        return d.withColumn("_new", F.when(prev.isNull() | (prev != F.col("swing_type")), 1.0)
                            .otherwise(0.0))
    runs = running_sum(over_chunks(idx, change, 1), "_new", "_run")
    best_hi = F.max_by(F.struct("ts", "price", "_to"), F.struct(F.col("price"), -F.col(BAR)))
    best_lo = F.min_by(F.struct("ts", "price", "_to"), F.struct(F.col("price"), F.col(BAR)))
    picked = (runs.groupBy(KEY, "_run", "swing_type")
              .agg(best_hi.alias("_h"), best_lo.alias("_l"))
              .select(KEY, "swing_type",
                      F.when(F.col("swing_type") == "high", F.col("_h")).otherwise(F.col("_l"))
                      .alias("_p")))
    return picked.select(KEY, F.col("_p.ts").alias("ts"), F.col("_p.price").alias("price"),
                         "swing_type", F.col("_p._to").alias("_to"))


def labelled_swings(bars: DataFrame, order: int = SWING_ORDER) -> DataFrame:
    """M4-M9, M11 on cleaned swings, one row per swing with ``sw_no``.

    Columns: symbol, ts, price, swing_type, label, seq_count, seq_dir, trend,
    prev_ts, prev_price, level, level_date, state_before, sw_no.
    """
    cleaned = clean_swings(swing_points(bars, order))
    seq = materialize(with_bar_no(cleaned, out=BAR, tiebreak=["_to"]), "swings")

    def first_pass(d, w):
        p2 = F.lag("price", 2).over(w)
        hi = F.col("swing_type") == "high"
        label = (F.when(p2.isNull(), F.when(hi, "H").otherwise("L"))
                 .when(hi, F.when(F.col("price") > p2, "HH").otherwise("LH"))
                 .otherwise(F.when(F.col("price") > p2, "HL").otherwise("LL")))
        d = d.withColumn("label", label)
        d = (d.withColumn("level", p2).withColumn("level_date", F.lag("ts", 2).over(w))
             .withColumn("prev_ts", F.lag("ts", 1).over(w))
             .withColumn("prev_price", F.lag("price", 1).over(w))
             .withColumn("_prev_label", F.lag("label", 1).over(w)))
        lab, prev = F.col("label"), F.col("_prev_label")
        d = d.withColumn("seq_dir", F.when(lab.isin(*BULL), "long").when(lab.isin(*BEAR), "short"))
        prev_dir = F.when(prev.isin(*BULL), "long").when(prev.isin(*BEAR), "short")
        d = d.withColumn("_run_start", F.when(
            F.col("seq_dir").isNotNull() & (prev_dir.isNull() | (prev_dir != F.col("seq_dir"))),
            F.col(BAR)))
        d = d.withColumn("_trend_sig", F.when(lab.isin(*BULL) & prev.isin(*BULL), "up")
                         .when(lab.isin(*BEAR) & prev.isin(*BEAR), "down"))
        # state signal: first labelled swing (position 2) sets by direction,
        # afterwards only HH -> up and LL -> down
        first = F.col(BAR) == 2
        d = d.withColumn("_state_sig", F.when(first & lab.isin(*BULL), "up")
                         .when(first & lab.isin(*BEAR), "down")
                         .when(~first & (lab == "HH"), "up")
                         .when(~first & (lab == "LL"), "down"))
        return d
    staged = materialize(over_chunks(seq, first_pass, 3), "swings")
    carried = carry_last(staged, ["_run_start", "_trend_sig", "_state_sig"],
                         ["_run_from", "_trend_c", "_state_after"])

    def second_pass(d, w):
        return d.withColumn("state_before", F.lag("_state_after", 1).over(w))
    out = over_chunks(carried, second_pass, 1)
    out = (out.withColumn("seq_count", F.when(F.col("seq_dir").isNull(), F.lit(0))
                          .otherwise((F.col(BAR) - F.col("_run_from") + 1).cast("int")))
              .withColumn("trend", F.coalesce(F.col("_trend_c"), F.lit("neutral"))))
    helpers = [c for c in out.columns if c.startswith("_")]
    return out.drop(*helpers).withColumnRenamed(BAR, SW)


def structure_signals(bars: DataFrame, swings: DataFrame) -> DataFrame:
    """BOS / CHoCH with the first bar that closed beyond the level.

    ``swings`` is :func:`labelled_swings` output; ``bars`` carries ``bar_no``.
    """
    return _signals_with_swing(bars, swings).drop("swing_ts")


def _signals_with_swing(bars: DataFrame, swings: DataFrame) -> DataFrame:
    st, lab = F.col("state_before"), F.col("label")
    sig = (swings.filter(F.col(SW) >= 3)
           .withColumn("type", F.when((st == "up") & (lab == "HH"), "bos")
                       .when((st == "up") & (lab == "LL"), "choch")
                       .when((st == "down") & (lab == "LL"), "bos")
                       .when((st == "down") & (lab == "HH"), "choch"))
           .withColumn("direction", F.when(lab == "HH", "long").when(lab == "LL", "short"))
           .filter(F.col("type").isNotNull())
           .select(KEY, SW, F.col("ts").alias("swing_ts"), F.col("price").alias("swing_price"),
                   "level", "level_date", "type", "direction"))
    # every bar -> the swing intervals [ts_{i-1}, ts_i] that contain it
    at = swings.groupBy(KEY, "ts").agg(F.min(SW).alias("_lo_at"), F.max(SW).alias("_hi_at"))
    b = materialize(bars.select(KEY, "ts", BAR, "close").join(at, [KEY, "ts"], "left"), "swing_bars")
    b = materialize(carry_next(b, "_lo_at", "_lo"), "swing_bars")
    b = carry_last(b, "_hi_at", "_hi")
    b = b.filter(F.col("_lo").isNotNull() & F.col("_hi").isNotNull())
    b = b.select(KEY, "ts", "close", F.explode(F.sequence(F.greatest(F.col("_lo"), F.lit(1)),
                                                           F.col("_hi") + 1)).alias(SW))
    cand = b.join(sig.select(KEY, SW, "level", "direction"), [KEY, SW], "inner")
    beyond = F.when(F.col("direction") == "long", F.col("close") > F.col("level")) \
        .otherwise(F.col("close") < F.col("level"))
    first = (cand.filter(beyond).groupBy(KEY, SW)
             .agg(F.min_by(F.struct("ts", "close"), F.col("ts")).alias("_b")))
    out = sig.join(first, [KEY, SW], "left")
    return out.select(KEY, F.coalesce(F.col("_b.ts"), F.col("swing_ts")).alias("ts"),
                      F.coalesce(F.col("_b.close"), F.col("swing_price")).alias("price"),
                      "level", "level_date", "type", "direction", "swing_ts")


def structure_features(bars: DataFrame, swings: DataFrame, order: int = SWING_ORDER) -> DataFrame:
    """D3: market structure as per-bar features, without look-ahead.

    A swing at bar i is confirmed only at bar i + order; from then on its
    facts are carried forward: distance of the close to the last swing high
    / low (%, from raw swing points), trend and consecutive bullish/bearish
    count of the last labelled swing, days since the last CHoCH break.
    """
    b = bars.select(KEY, "ts", BAR, "close")
    at = b.select(KEY, "ts", F.col(BAR).alias("_sb"))
    raw = swing_points(bars, order).join(at, [KEY, "ts"])
    known = (F.col("_sb") + order).alias(BAR)
    hi = raw.filter(F.col("swing_type") == "high").select(KEY, known, F.col("price").alias("_hi_at"))
    lo = raw.filter(F.col("swing_type") == "low").select(KEY, known, F.col("price").alias("_lo_at"))
    lab = (swings.join(at, [KEY, "ts"]).groupBy(KEY, known)
           .agg(F.max_by(F.struct("trend", "seq_count", "seq_dir"), F.col(SW)).alias("_lab")))
    ch = (_signals_with_swing(bars, swings).filter(F.col("type") == "choch")
          .join(at.withColumnRenamed("ts", "swing_ts"), [KEY, "swing_ts"])
          .groupBy(KEY, known).agg(F.max("ts").alias("_choch_at")))
    ev = (b.join(hi, [KEY, BAR], "left").join(lo, [KEY, BAR], "left")
          .join(lab, [KEY, BAR], "left").join(ch, [KEY, BAR], "left"))
    ev = carry_last(ev, ["_hi_at", "_lo_at", "_lab", "_choch_at"])
    pct = lambda ref: ratio(F.col("close") - F.col(ref), F.col(ref)) * 100
    return ev.select(
        KEY, "ts",
        F.coalesce(F.col("_lab.trend"), F.lit("neutral")).alias("structure_trend"),
        pct("_hi_at").alias("swing_distance_high"),
        pct("_lo_at").alias("swing_distance_low"),
        F.when(F.col("_lab.seq_dir") == "long", F.col("_lab.seq_count")).otherwise(F.lit(0)).alias("consecutive_bullish"),
        F.when(F.col("_lab.seq_dir") == "short", F.col("_lab.seq_count")).otherwise(F.lit(0)).alias("consecutive_bearish"),
        F.datediff(F.col("ts"), F.col("_choch_at")).alias("days_since_choch"))
