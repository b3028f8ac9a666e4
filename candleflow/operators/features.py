"""Side-series panel, alignment, stationarity transform, the feature table and
its manifest.

Feature-table semantics (per series, in this order):

1. label from the full bar series (``target``, carried aside, never filled);
2. indicators; rows with any NULL indicator are dropped (warm-up: 60 bars);
3. side closes joined on ``ts`` (left; missing -> NULL) and filled over the
   *surviving* rows: forward (the default, it never looks ahead), or
   ``fill="cubic"``: order-3 interpolation of interior gaps, then back fill;
4. stationarity, by column name: EMA/SAR -> (x - C)/C, MACD* -> x/C, rate series -> diff,
   close/volume/other side closes -> pct_change, OBV -> diff(OBV)/C; a
   division by zero gives 0 (inf -> 0), 0/0 gives NULL.  "Previous" means
   the previous surviving row, as in the reference's drop-then-diff order;
5. rows with any NULL dropped, label re-attached by key.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleflow.functions.scalar import ratio
from candleflow.operators import fill as FL
from candleflow.operators import indicators as I
from candleflow.plans.series import BAR, KEY, carry_last, over_chunks, running_sum, with_bar_no
from candleflow.session import materialize

ANCHOR = "AF"                      # anchor series of the driver data

INDICATOR_COLS = ["ema_10", "ema_20", "psar", "rsi", "roc", "obv", "macd", "macd_signal", "cci",
                  "adosc", "stoch_k", "dmi_pos", "dmi_neg", "adx", "bb_pband", "bb_width",
                  "atr_norm"] + [f"ret_lag{k}" for k in I.RETURN_LAGS] + \
                 [f"vol_roll{k}" for k in I.VOL_WINDOWS] + ["gap_ret", "intraday_range"]


def side_name(symbol: str) -> str:
    return f"{symbol}_close"


def side_panel(bars: DataFrame, side_symbols: list[str]) -> DataFrame:
    """Wide ``(ts, <sym>_close ...)``: one row per date where any side series
    has a bar.  Explicit pivot values: no extra job to discover them."""
    wide = (bars.filter(F.col(KEY).isin(side_symbols))
            .groupBy("ts").pivot(KEY, side_symbols).agg(F.first("close")))
    for s in side_symbols:
        wide = wide.withColumnRenamed(s, side_name(s))
    return wide


def close_panel(bars: DataFrame, anchor: str, side_symbols: list[str]) -> DataFrame:
    """Anchor calendar left-joined with the side closes."""
    anchor_bars = bars.filter(F.col(KEY) == anchor).select("ts", F.col("close").alias(side_name(anchor)))
    return anchor_bars.join(side_panel(bars, side_symbols), "ts", "left")


def long_panel(bars: DataFrame, anchor: str, side_symbols: list[str]) -> DataFrame:
    """Side closes in long form on the anchor calendar: ``(symbol, ts, close)``
    with NULL where the side series has no bar on an anchor date."""
    cal = bars.filter(F.col(KEY) == anchor).select("ts")
    grid = cal.withColumn(KEY, F.explode(F.array(*[F.lit(s) for s in side_symbols])))
    side = bars.filter(F.col(KEY).isin(side_symbols)).select(KEY, "ts", "close")
    return grid.join(side, [KEY, "ts"], "left")


# ------------------------------------------------------------------ indicators

FEATURE_LOOKBACK = I.VOL_WINDOWS[-1] + 1
BOUNDED = [I.daily_return_cols, I.lagged_return_cols, I.rolling_vol_cols, I.gap_return_cols,
           I.intraday_range_cols, I.roc_cols, I.stoch_k_cols, I.cci_cols, I.cmf_cols,
           I.bollinger_cols, I.obv_sign_cols, I.target_cols]


def indicator_frame(bars: DataFrame) -> DataFrame:
    """All indicators + target per bar (``bars`` carries ``bar_no``).

    One (symbol, chunk) window pass for every bounded indicator, one
    two-level scan for OBV, two recurrence passes, one grouped SAR pass.
    """
    bounded = I.with_windows(bars, BOUNDED + [I.true_range_cols, I.directional_move_cols,
                                              I.price_move_cols],
                             FEATURE_LOOKBACK, I.TARGET_HORIZON)
    with_obv = materialize(running_sum(bounded, "_obv_flow", "obv").drop("_obv_flow"), "bounded")
    rec = I.recursive_indicators(with_obv)
    return rec.join(I.psar_values(bars), [KEY, BAR], "inner")


def stationary(ind: DataFrame, side_cols: list[str] = (), rate_cols: list[str] = ()) -> DataFrame:
    """W16-W20 on contiguous rows (``bar_no`` indexes the surviving rows).

    ``close`` is the price level captured before any column is rewritten.
    """
    diff_cols = ["close", "volume", "obv"] + list(side_cols)

    def prev(d, w):
        return d.withColumns({f"_p_{c}": F.lag(c, 1).over(w) for c in diff_cols})
    ind = over_chunks(ind.withColumn("_level", F.col("close")), prev, 1)
    C = F.col("_level")
    new = {}
    for c in ind.columns:  # by name pattern: an added window needs no change here
        if re.fullmatch(r"ema_\d+|psar", c):
            new[c] = ratio(F.col(c) - C, C)
        elif re.fullmatch(r"macd(_\w+)?", c):
            new[c] = ratio(F.col(c), C)
    for c in side_cols:
        new[c] = (F.col(c) - F.col(f"_p_{c}") if c in rate_cols
                  else I.pct_change(F.col(c), F.col(f"_p_{c}")))
    new["close"] = I.pct_change(F.col("close"), F.col("_p_close"))
    new["volume"] = I.pct_change(F.col("volume"), F.col("_p_volume"))
    new["obv"] = ratio(F.col("obv") - F.col("_p_obv"), C)
    ind = ind.withColumns(new)
    return ind.drop("_level", *[f"_p_{c}" for c in diff_cols])


FEATURE_COLS = ["close", "volume"] + INDICATOR_COLS


def surviving_indicators(bars: DataFrame) -> DataFrame:
    """Indicator rows without any NULL indicator, re-indexed 0.. per series."""
    ind = indicator_frame(bars)
    ok = F.lit(True)
    for c in INDICATOR_COLS:
        ok = ok & F.col(c).isNotNull()
    base = ["symbol", "ts", "close", "volume", "target"] + INDICATOR_COLS
    return with_bar_no(ind.filter(ok).select(*base))


def align_panel(surviving: DataFrame, bars: DataFrame, side_symbols: list[str]) -> DataFrame:
    """Side closes joined on ``ts`` to the surviving rows (NULL = gap)."""
    return surviving.join(side_panel(bars, list(side_symbols)), "ts", "left")


def fill_sides(aligned: DataFrame, side_cols: list[str], fill: str = "ffill") -> DataFrame:
    """Side closes without gaps: ``ffill``, or ``cubic`` (then back fill).

    For the spline the columns become one long table of (symbol, side) series,
    so all of them are solved together.
    """
    if fill == "ffill":
        return carry_last(aligned, side_cols)
    if fill != "cubic":
        raise ValueError(f"unknown fill: {fill}")
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in side_cols])
    series = materialize(aligned.select(KEY, "ts", BAR, F.explode(pairs).alias("p")).select(
        F.concat_ws("|", KEY, "p.name").alias(KEY), F.col(KEY).alias("_symbol"), F.col("p.name").alias("_name"),
        "ts", BAR, F.col("p.v").alias("v")), "sides")
    full = FL.bfill(materialize(FL.interpolate_cubic(series, "v"), "sides"), ["v"])
    wide = full.groupBy(F.col("_symbol").alias(KEY), BAR).agg(*[
        F.max(F.when(F.col("_name") == c, F.col("v"))).alias(c) for c in side_cols])
    return aligned.drop(*side_cols).join(wide, [KEY, BAR])


def feature_table(bars: DataFrame, side_symbols: list[str], rate_symbols: list[str] = (),
                  surviving: DataFrame | None = None, fill: str = "ffill") -> DataFrame:
    """``(symbol, ts, features..., side closes..., target)``.

    ``bars`` carries ``bar_no``; the closes of ``side_symbols`` are joined on
    ``ts`` to every series and filled over its surviving rows.  Series in
    ``rate_symbols`` (rates, not prices) are differenced.
    """
    if surviving is None:
        surviving = materialize(surviving_indicators(bars), "surviving")
    side_cols = [side_name(s) for s in side_symbols]
    aligned = fill_sides(align_panel(surviving, bars, side_symbols), side_cols, fill)
    st = stationary(aligned, side_cols, [side_name(s) for s in rate_symbols])
    cols = ["symbol", "ts"] + FEATURE_COLS + side_cols
    return st.select(*cols, "target").dropna(subset=cols)


def interaction_features(feats: DataFrame, partner: str) -> DataFrame:
    """Explicit interactions on the feature table.

    ``rsi_x_volume`` = RSI x volume change; ``return_ratio`` = own return /
    the ``partner`` side series' return; ``atr_vol_ratio`` = ATR_norm /
    20-bar realised volatility (divisions by the ``ratio`` null model).
    """
    return feats.select(
        KEY, "ts",
        (F.col("rsi") * F.col("volume")).alias("rsi_x_volume"),
        ratio(F.col("close"), F.col(side_name(partner))).alias("return_ratio"),
        ratio(F.col("atr_norm"), F.col("vol_roll20")).alias("atr_vol_ratio"))


# ------------------------------------------------------------------ manifest

def manifest(df: DataFrame) -> DataFrame:
    """Feature manifest: sorted columns, row count, 16-hex hash of the JSON list.

    The column list is schema metadata (plan time); the row count is a
    distributed count.
    """
    cols = sorted(df.columns)
    payload = json.dumps(cols)
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(payload).alias("columns_json"),
        F.lit(len(cols)).alias("n_columns"),
        F.col("row_count"),
        F.substring(F.sha2(F.lit(payload), 256), 1, 16).alias("column_hash"))


def manifest_hash_py(columns: list[str]) -> str:
    """Driver-side hash of a column list (schema-only check before scoring)."""
    return hashlib.sha256(json.dumps(sorted(columns)).encode()).hexdigest()[:16]


def manifest_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """From two manifests, columns ``missing`` in the second and
    ``extra`` in it, with the row count of the table that has them."""
    def columns(m):
        return m.select(F.explode(F.from_json("columns_json", "array<string>")).alias("column"), "row_count")
    e, a = columns(expected), columns(actual)
    return (e.join(a.select("column"), "column", "left_anti").withColumn("status", F.lit("missing"))
            .unionByName(a.join(e.select("column"), "column", "left_anti").withColumn("status", F.lit("extra"))))


__all__ = ["close_panel", "long_panel", "side_panel", "indicator_frame", "stationary",
           "feature_table", "manifest", "manifest_diff", "surviving_indicators", "align_panel"]
