"""Registered queries: ``name -> f(spark, sf_dir) -> DataFrame``.

Each query derives its input from the driver tables (bars from ``lineitem``
or ``events``), so its work grows with the data.  Doubles that are computed
(not copied) are rounded at the output: 6 decimals, 4 for price-level
recursive values; the oracle SQL applies the same rounding.
"""

from __future__ import annotations

import contextvars
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleflow.operators import indicators as I
from candleflow.session import join_small
from candleflow.sources import bars as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class _Ctx:
    """Per-invocation memo: inside one query call, shared inputs (indexed
    bars, feature table, predictions, ...) are built -- and written -- once.
    Nothing is shared between invocations."""

    def __init__(self, spark, sf):
        self.spark, self.sf, self.memo_ = spark, sf, {}

    def memo(self, key, build):
        if key not in self.memo_:
            self.memo_[key] = build()
        return self.memo_[key]

    @property
    def bars(self) -> DataFrame:
        return self.memo("bars", lambda: S.indexed_bars(self.spark, self.sf))

    @property
    def daily(self) -> DataFrame:
        if "bars" in self.memo_:
            return self.memo_["bars"].drop("bar_no")
        return S.daily_bars(self.spark, self.sf)


_CURRENT: contextvars.ContextVar = contextvars.ContextVar("candleflow_query_ctx", default=None)


def _ctx(spark, sf) -> _Ctx:
    cur = _CURRENT.get()
    return cur if cur is not None and cur.sf == sf else _Ctx(spark, sf)


def query(name: str):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark, sf, *args, **kwargs):
            if _CURRENT.get() is not None and _CURRENT.get().sf == sf:
                return fn(spark, sf, *args, **kwargs)
            token = _CURRENT.set(_Ctx(spark, sf))
            try:
                return fn(spark, sf, *args, **kwargs)
            finally:
                _CURRENT.reset(token)
        QUERIES[name] = run
        return run
    return deco


def _round(df: DataFrame, r6=(), r4=(), r3=(), r2=()) -> DataFrame:
    for cols, scale in ((r6, 6), (r4, 4), (r3, 3), (r2, 2)):
        for c in cols:
            df = df.withColumn(c, F.round(F.col(c), scale))
    return df


BAR_COLS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


# ------------------------------------------------------------------ sources

@query("scan_bars")
def scan_bars(spark, sf):
    """Typed, column-pruned scan of the trade table (one row per trade)."""
    t = S.trades_from_lineitem(S.read_table(spark, sf, "lineitem"))
    return t.select("symbol", "ts", "price", "qty")


@query("ohlcv_bars")
def ohlcv_bars(spark, sf):
    """Daily OHLCV bars from line items."""
    return S.daily_bars(spark, sf).select(*BAR_COLS)  # noqa: direct source


@query("ohlcv_bars_hourly")
def ohlcv_bars_hourly(spark, sf):
    """Hourly OHLCV bars from events."""
    return S.hourly_bars(spark, sf).select(*BAR_COLS)


@query("recent_bars")
def recent_bars(spark, sf):
    """Bars of the last 12 months before the newest bar."""
    return S.recent(_ctx(spark, sf).daily, 12, S.newest_day(spark, sf)).select(*BAR_COLS)


@query("latest_rows")
def latest_rows(spark, sf, n: int = 5):
    """L1: newest n bars per series (rank-limited window: top-n per task
    before the shuffle)."""
    from pyspark.sql import Window
    w = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    return (_ctx(spark, sf).daily.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= n).drop("_rn").select(*BAR_COLS))


@query("drop_tail")
def drop_tail(spark, sf, n: int = 10):
    """L2: all but the newest n bars per series (position vs series length)."""
    bars = _ctx(spark, sf).bars
    sizes = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    return (join_small(bars, sizes, "symbol").filter(F.col("bar_no") < F.col("_n") - n)
            .select(*BAR_COLS))


# ------------------------------------------------------------------ windows

def _windowed(spark, sf, builders, lookback, lookahead=0):
    return I.with_windows(_ctx(spark, sf).bars, builders, lookback, lookahead)


@query("target_label")
def target_label(spark, sf):
    """Forward-return label with a +-3 % dead zone."""
    return _windowed(spark, sf, [I.target_cols], 0, I.TARGET_HORIZON) \
        .select("symbol", "ts", "close", "target")


@query("daily_return")
def daily_return(spark, sf):
    return _round(_windowed(spark, sf, [I.daily_return_cols], 1)
                  .select("symbol", "ts", "ret"))


@query("roc")
def roc(spark, sf):
    return _round(_windowed(spark, sf, [I.roc_cols], I.ROC_WINDOW)
                  .select("symbol", "ts", "roc"))


LAG_COLS = [f"ret_lag{k}" for k in I.RETURN_LAGS]
VOL_COLS = [f"vol_roll{k}" for k in I.VOL_WINDOWS]


@query("lagged_returns")
def lagged_returns(spark, sf):
    df = _windowed(spark, sf, [I.daily_return_cols, I.lagged_return_cols], 1 + max(I.RETURN_LAGS))
    return df.select("symbol", "ts", *LAG_COLS)


@query("rolling_vol")
def rolling_vol(spark, sf):
    df = _windowed(spark, sf, [I.daily_return_cols, I.rolling_vol_cols], max(I.VOL_WINDOWS))
    return _round(df.select("symbol", "ts", *VOL_COLS), r6=VOL_COLS)


@query("gap_return")
def gap_return(spark, sf):
    return _round(_windowed(spark, sf, [I.gap_return_cols], 1)
                  .select("symbol", "ts", "gap_ret"))


@query("intraday_range")
def intraday_range(spark, sf):
    df = I.intraday_range_cols(_ctx(spark, sf).daily)
    return _round(df.select("symbol", "ts", "intraday_range"))


@query("obv")
def obv(spark, sf):
    return I.obv(_ctx(spark, sf).bars).select("symbol", "ts", "obv")


@query("stoch_k")
def stoch_k(spark, sf):
    return _round(_windowed(spark, sf, [I.stoch_k_cols], I.STOCH_WINDOW)
                  .select("symbol", "ts", "stoch_k"))


@query("cci")
def cci(spark, sf):
    return _round(_windowed(spark, sf, [I.cci_cols], I.CCI_WINDOW)
                  .select("symbol", "ts", "cci"), r6=["cci"])


@query("cmf")
def cmf(spark, sf):
    return _round(_windowed(spark, sf, [I.cmf_cols], I.CMF_WINDOW)
                  .select("symbol", "ts", "adosc"), r6=["adosc"])


@query("bb_pband")
def bb_pband(spark, sf):
    return _round(_windowed(spark, sf, [I.bollinger_cols], I.BB_WINDOW)
                  .select("symbol", "ts", "bb_pband"), r6=["bb_pband"])


@query("bb_width")
def bb_width(spark, sf):
    return _round(_windowed(spark, sf, [I.bollinger_cols], I.BB_WINDOW)
                  .select("symbol", "ts", "bb_width"), r6=["bb_width"])


@query("sma20")
def sma20(spark, sf):
    return _round(_windowed(spark, sf, [I.sma_cols], I.SMA_OVERLAY)
                  .select("symbol", "ts", "sma20"), r6=["sma20"])


@query("true_range")
def true_range(spark, sf):
    return _round(_windowed(spark, sf, [I.true_range_cols], 1)
                  .select("symbol", "ts", "true_range"))


# ------------------------------------------------------------------ recursive

def recursive(spark, sf, *wanted):
    """Bars with the wanted recursive indicators; nothing else is computed,
    and only the columns that they read are carried."""
    c = _ctx(spark, sf)
    return c.memo(("recursive", wanted), lambda: I.recursive_indicators(
        I.recursive_inputs(c.bars.select("symbol", "ts", "bar_no", "open", "high", "low", "close"), wanted),
        wanted=wanted))


@query("ema")
def ema(spark, sf):
    return _round(recursive(spark, sf, "ema_10", "ema_20").select("symbol", "ts", "ema_10", "ema_20"),
                  r4=["ema_10", "ema_20"])


@query("macd")
def macd(spark, sf):
    return _round(recursive(spark, sf, "macd", "macd_signal").select("symbol", "ts", "macd", "macd_signal"),
                  r4=["macd", "macd_signal"])


@query("rsi")
def rsi(spark, sf):
    return _round(recursive(spark, sf, "rsi").select("symbol", "ts", "rsi"), r4=["rsi"])


@query("atr")
def atr(spark, sf):
    return _round(recursive(spark, sf, "atr", "atr_norm").select("symbol", "ts", "atr", "atr_norm"),
                  r4=["atr"], r6=["atr_norm"])


@query("dmi")
def dmi(spark, sf):
    return _round(recursive(spark, sf, "dmi_pos", "dmi_neg").select("symbol", "ts", "dmi_pos", "dmi_neg"),
                  r4=["dmi_pos", "dmi_neg"])


@query("adx")
def adx(spark, sf):
    return _round(recursive(spark, sf, "adx").select("symbol", "ts", "adx"), r4=["adx"])


@query("psar")
def psar(spark, sf):
    return I.psar(_ctx(spark, sf).bars).select("symbol", "ts", "psar")


# ------------------------------------------------------------------ panel / features

from candleflow.operators import features as FT  # noqa: E402
from candleflow.operators import fill as FL  # noqa: E402
from candleflow.plans.series import running_sum, with_bar_no  # noqa: E402
from candleflow.session import materialize  # noqa: E402

ANCHOR = FT.ANCHOR
SIDE = ["AO", "NF", "NO", "RF", "RO"]      # the five non-anchor series
SIDE_COLS = [FT.side_name(s) for s in SIDE]


@query("close_panel")
def close_panel(spark, sf):
    """Anchor calendar with every series' close as a column."""
    return FT.close_panel(_ctx(spark, sf).daily, ANCHOR, SIDE)


def _long_panel(spark, sf):
    return with_bar_no(FT.long_panel(_ctx(spark, sf).daily, ANCHOR, SIDE))


@query("ffill")
def ffill(spark, sf):
    """G1: side closes on the anchor calendar, forward filled."""
    return FL.ffill(_long_panel(spark, sf), ["close"]).select("symbol", "ts", "close")


@query("bfill")
def bfill(spark, sf):
    """Side closes on the anchor calendar, back filled."""
    return FL.bfill(_long_panel(spark, sf), ["close"]).select("symbol", "ts", "close")


@query("interpolate_linear")
def interpolate_linear(spark, sf):
    """G3 (linear): positional interpolation of interior gaps."""
    out = FL.interpolate_linear(_long_panel(spark, sf), "close")
    return out.select("symbol", "ts", "close")


@query("interpolate_cubic")
def interpolate_cubic(spark, sf):
    """G3 (cubic): not-a-knot spline over the time axis, interior gaps only."""
    panel = materialize(_long_panel(spark, sf).withColumn("known", F.col("close")), "long_panel")
    out = FL.interpolate_cubic(panel, "close")
    return out.select("symbol", "ts", F.coalesce("known", F.round("close", 5)).alias("close"))


def _surviving(spark, sf):
    c = _ctx(spark, sf)
    return c.memo("surviving", lambda: materialize(FT.surviving_indicators(c.bars), "surviving"))


@query("align_panel")
def align_panel(spark, sf):
    """Side closes aligned to each series' post-warm-up calendar."""
    bars = _ctx(spark, sf).daily
    return FT.align_panel(_surviving(spark, sf), bars, SIDE).select("symbol", "ts", *SIDE_COLS)


STAT_COLS = FT.FEATURE_COLS


@query("stationary")
def stationary(spark, sf):
    """W16-W20 + P12 + P4 per series (no side panel)."""
    st = FT.stationary(_surviving(spark, sf))
    out = st.select("symbol", "ts", *STAT_COLS).dropna()
    return _round(out, r6=STAT_COLS)


def feature_frame(spark, sf):
    return FT.feature_table(_ctx(spark, sf).bars, SIDE, surviving=_surviving(spark, sf))


@query("feature_table")
def feature_table(spark, sf):
    """The full feature table (features, side closes, label)."""
    return _round(feature_frame(spark, sf), r6=FT.FEATURE_COLS + SIDE_COLS)


@query("feature_table_filled")
def feature_table_filled(spark, sf):
    """Side gaps by order-3 interpolation and back fill; RO is
    taken as a rate and differenced."""
    out = FT.feature_table(_ctx(spark, sf).bars, SIDE, ["RO"], surviving=_surviving(spark, sf), fill="cubic")
    return _round(out, r6=FT.FEATURE_COLS + SIDE_COLS)


@query("manifest_hash")
def manifest_hash(spark, sf):
    """manifest of the feature table (sorted names, rows, hash)."""
    return FT.manifest(feature_frame(spark, sf))


@query("manifest_diff")
def manifest_diff(spark, sf):
    """J7/U4/ML14: stored manifest of the training features against that of
    another stored feature table (no side closes, no label)."""
    import uuid

    from candleflow.session import checkpoint_dir
    store = TableStore(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    store.save("features", feature_frame(spark, sf))
    store.save("scoring", FT.stationary(_surviving(spark, sf)).select("symbol", "ts", *STAT_COLS))
    for name in ("features", "scoring"):
        store.save(f"{name}_manifest", FT.manifest(store.load(name)))
    return FT.manifest_diff(store.load("features_manifest"), store.load("scoring_manifest"))


# ------------------------------------------------------------------ market structure

from candleflow.operators import structure as M  # noqa: E402
from candleflow.sources.store import TableStore  # noqa: E402


@query("atr_days")
def atr_days(spark, sf):
    """M1: range / ATR14 classification per bar."""
    out = M.atr_days(recursive(spark, sf, "atr"))
    return _round(out.select("symbol", "ts", "atr_ratio", "is_up", "double_atr", "single_atr"),
                  r6=["atr_ratio"])


@query("atr_double_days")
def atr_double_days(spark, sf):
    """M2: days with range >= 2 ATR, split up/down, with their close."""
    out = M.atr_days(recursive(spark, sf, "atr")).filter(F.col("double_atr"))
    return _round(out.select("symbol", "ts", F.when(F.col("is_up"), "up").otherwise("down")
                             .alias("direction"), "close", "atr_ratio"), r6=["atr_ratio"])


@query("swing_points")
def swing_points(spark, sf):
    return M.swing_points(_ctx(spark, sf).bars)


@query("swings_clean")
def swings_clean(spark, sf):
    return M.clean_swings(M.swing_points(_ctx(spark, sf).bars)) \
        .select("symbol", "ts", "price", "swing_type")


def _swings(spark, sf):
    c = _ctx(spark, sf)
    return c.memo("swings", lambda: materialize(M.labelled_swings(c.bars), "labelled_swings"))


@query("swing_labels")
def swing_labels(spark, sf):
    return _swings(spark, sf).select("symbol", "ts", "swing_type", "price", "label")


@query("swing_sequences")
def swing_sequences(spark, sf):
    return _swings(spark, sf).select("symbol", "ts", "swing_type", "label", "seq_count", "seq_dir")


@query("swing_trend")
def swing_trend(spark, sf):
    return _swings(spark, sf).select("symbol", "ts", "swing_type", "label", "trend")


@query("zigzag_segments")
def zigzag_segments(spark, sf):
    """M8: consecutive swing pairs with the trend of the later swing."""
    sw = _swings(spark, sf).filter(F.col("prev_ts").isNotNull())
    return sw.select("symbol", F.col("prev_ts").alias("from_ts"), F.col("prev_price").alias("from_price"),
                     F.col("ts").alias("to_ts"), F.col("price").alias("to_price"), "trend")


@query("prevailing_trend")
def prevailing_trend(spark, sf):
    """M9: prevailing state before each swing."""
    return _swings(spark, sf).select("symbol", "ts", "swing_type", "label", "state_before")


def _signals(spark, sf):
    return M.structure_signals(_ctx(spark, sf).bars, _swings(spark, sf))


@query("structure_signals")
def structure_signals(spark, sf):
    """BOS / CHoCH with broken level and break bar."""
    return _signals(spark, sf)


@query("choch_signals")
def choch_signals(spark, sf):
    """Change-of-character signals only."""
    return _signals(spark, sf).filter(F.col("type") == "choch")


@query("seq3_signals")
def seq3_signals(spark, sf):
    """Third consecutive swing of one direction."""
    return _swings(spark, sf).filter(F.col("seq_count") == 3) \
        .select("symbol", "ts", "price", "label", "seq_dir")


@query("multi_tf_structure")
def multi_tf_structure(spark, sf):
    """Swings on daily (order 5) and weekly (order 3) bars."""
    daily = M.labelled_swings(_ctx(spark, sf).bars).withColumn("timeframe", F.lit("1d"))
    trades = S.trades_from_lineitem(S.read_table(spark, sf, "lineitem"))
    weekly = with_bar_no(S.ohlcv(trades, F.date_trunc("week", F.col("ts")).cast("date")))
    wk = M.labelled_swings(weekly, order=3).withColumn("timeframe", F.lit("1w"))
    cols = ["timeframe", "symbol", "ts", "swing_type", "price", "label", "trend"]
    return daily.select(*cols).unionByName(wk.select(*cols))


# ------------------------------------------------------------------ predictions / outcomes

from candleflow.functions.scalar import confidence_label as _conf_label  # noqa: E402
from candleflow.functions.scalar import position_size as _position  # noqa: E402
from candleflow.operators import outcomes as O  # noqa: E402
from candleflow.sources.store import TableStore  # noqa: E402


def _predictions(spark, sf):
    c = _ctx(spark, sf)
    return c.memo("predictions", lambda: materialize(
        O.predictions_from_bars(I.with_windows(c.bars, [I.sma_cols], I.SMA_OVERLAY)), "predictions"))


PRED_COLS = ["symbol", "ts", "prediction", "confidence", "horizon_days", "entry_price"]


@query("predictions")
def predictions(spark, sf):
    """Prediction table derived from bars (input of the outcome queries)."""
    return _round(_predictions(spark, sf).select(*PRED_COLS), r6=["confidence"])


def _outcomes(spark, sf):
    return O.prediction_outcomes(_predictions(spark, sf), _ctx(spark, sf).daily)


@query("prediction_outcomes")
def prediction_outcomes(spark, sf):
    """Forward as-of exit bar 10 calendar days later, P&L, status."""
    return _round(_outcomes(spark, sf), r6=["confidence"])


@query("hourly_outcomes")
def hourly_outcomes(spark, sf):
    """J4/J5 on hourly bars: as-of on timestamps, 10 days later to the hour."""
    bars = S.indexed_bars(spark, sf, hourly=True)
    preds = materialize(O.predictions_from_bars(I.with_windows(bars, [I.sma_cols], I.SMA_OVERLAY)), "predictions")
    return _round(O.prediction_outcomes(preds, bars.drop("bar_no")), r6=["confidence"])


@query("pnl_summary")
def pnl_summary(spark, sf):
    """A1 + P8: summary over closed outcomes."""
    return _round(O.pnl_summary(_outcomes(spark, sf)), r6=["total_pnl", "accuracy", "avg_return"])


@query("results_table")
def results_table(spark, sf):
    """Formatted result table, newest first."""
    return O.results_table(_outcomes(spark, sf))


@query("confidence_label")
def confidence_label(spark, sf):
    """P10: Strong / Moderate / Weak."""
    p = _predictions(spark, sf)
    return _round(p.select("symbol", "ts", "confidence", _conf_label("confidence").alias("label")),
                  r6=["confidence"])


@query("position_size")
def position_size(spark, sf):
    """Full / half / flat position from confidence."""
    p = _predictions(spark, sf)
    return _round(p.select("symbol", "ts", "confidence", _position("confidence").alias("position")),
                  r6=["confidence"])


@query("prediction_markers")
def prediction_markers(spark, sf):
    """Predictions on dates that exist in the bars, with the bar close."""
    p = _predictions(spark, sf)
    bars = _ctx(spark, sf).daily.select("symbol", "ts", "close")
    return (p.join(bars, ["symbol", "ts"], "inner")
            .select("symbol", "ts", F.when(F.col("prediction") == 1, "up").otherwise("down")
                    .alias("marker"), "close"))


@query("visible_predictions")
def visible_predictions(spark, sf):
    """Predictions not older than the first bar of the last 6 months."""
    recent = S.recent(_ctx(spark, sf).daily, 6, S.newest_day(spark, sf))
    first = recent.groupBy("symbol").agg(F.min("ts").alias("_first"))
    p = join_small(_predictions(spark, sf), first, "symbol").filter(F.col("ts") >= F.col("_first"))
    return _round(p.select("symbol", "ts", "prediction", "confidence"), r6=["confidence"])


def _new_batch(spark, sf):
    """A second prediction run over all bars (SMA-10 rule)."""
    ind = I.with_windows(_ctx(spark, sf).bars, [lambda d, w: I.sma_cols(d, w, 10, "sma20")], 10)
    return O.predictions_from_bars(ind)


@query("dedupe_last")
def dedupe_last(spark, sf):
    """U1+U2: old and new predictions, last arrival per (symbol, ts) wins."""
    old = _predictions(spark, sf).withColumn("arrival", F.lit(1))
    new = _new_batch(spark, sf).withColumn("arrival", F.lit(2))
    out = O.dedupe_last(old.unionByName(new), ["symbol", "ts"], "arrival")
    return _round(out.select(*PRED_COLS), r6=["confidence"])


@query("upsert_predictions")
def upsert_predictions(spark, sf):
    """U3 + P9: upsert into a versioned store (timestamps normalised to day)."""
    import uuid
    store = TableStore(spark, f"{__import__('candleflow').checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    store.save("predictions", _predictions(spark, sf))
    new = _new_batch(spark, sf).withColumn(
        "ts", F.date_trunc("day", F.col("ts").cast("timestamp") + F.expr("INTERVAL 15 HOURS")).cast("date"))
    out = store.upsert("predictions", new, ["symbol", "ts"])
    return _round(out.select(*PRED_COLS), r6=["confidence"])


# ------------------------------------------------------------------ profiling

from candleflow.operators import dataset as D  # noqa: E402
from candleflow.operators import profile as P  # noqa: E402

PROFILE_COLS = FT.FEATURE_COLS + SIDE_COLS
DESCRIBE_COLS = ["rsi", "roc", "macd", "cci", "adx", "dmi_pos", "dmi_neg", "stoch_k", "obv", "adosc"]


def _features(spark, sf):
    c = _ctx(spark, sf)
    return c.memo("features", lambda: materialize(feature_frame(spark, sf), "features"))


@query("target_counts")
def target_counts(spark, sf):
    """A2: rows per label value (NULL = dead zone / unresolved tail)."""
    return _features(spark, sf).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("dead_zone_stats")
def dead_zone_stats(spark, sf):
    """A4: count and share of bars without a label, per series."""
    t = target_label(spark, sf)
    return _round(t.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("target").isNull()).alias("n_dead"),
        (100.0 * F.count_if(F.col("target").isNull()) / F.count(F.lit(1))).alias("pct_dead")),
        r6=["pct_dead"])


@query("data_quality")
def data_quality(spark, sf):
    """A5: nulls, duplicate keys, time range, column types of the close panel."""
    panel = close_panel(spark, sf)
    cols = panel.columns
    n_double = sum(1 for f in panel.schema.fields if f.dataType.typeName() == "double")
    nulls = sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0))
    return panel.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(nulls).alias("null_total"),
                     (F.count(F.lit(1)) - F.countDistinct("ts")).alias("dup_keys"),
                     F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts")) \
        .withColumn("n_double_cols", F.lit(n_double)) \
        .withColumn("n_other_cols", F.lit(len(cols) - n_double))


@query("describe_indicators")
def describe_indicators(spark, sf):
    """describe() of the oscillator columns, rounded to 2 decimals."""
    d = P.describe(_features(spark, sf), DESCRIBE_COLS)
    return _round(d, r2=["mean", "std", "min", "p25", "p50", "p75", "max"])


@query("feature_ranges")
def feature_ranges(spark, sf):
    """Grouped range profile."""
    return _round(P.feature_ranges(_features(spark, sf), PROFILE_COLS),
                  r2=["min", "max", "mean", "std", "range"])


@query("range_extremes")
def range_extremes(spark, sf):
    """Largest / smallest feature ranges and their ratio."""
    return _round(P.range_extremes(_features(spark, sf), PROFILE_COLS), r6=["range"], r2=["ratio"])


@query("target_corr")
def target_corr(spark, sf):
    """Correlation of every feature with the label."""
    return _round(P.target_corr(_features(spark, sf), PROFILE_COLS), r6=["corr"])


@query("corr_pairs")
def corr_pairs(spark, sf):
    """A10: feature pairs with |corr| > 0.9."""
    return _round(P.corr_pairs(_features(spark, sf), PROFILE_COLS), r3=["corr"])


@query("corr_pairs_gaps")
def corr_pairs_gaps(spark, sf):
    """A10 on a panel with gaps: every pair of the close panel over the dates
    that have both."""
    panel = close_panel(spark, sf)
    return _round(P.pairwise_corr(panel, [c for c in panel.columns if c != "ts"]), r6=["corr"])


@query("corr_drop")
def corr_drop(spark, sf):
    """Later column of each highly correlated pair."""
    return P.corr_drop(P.corr_pairs(_features(spark, sf), PROFILE_COLS))


@query("price_bounds")
def price_bounds(spark, sf):
    """Chart y-ranges over the last 6 months."""
    r = S.recent(_ctx(spark, sf).daily, 6, S.newest_day(spark, sf))
    return r.groupBy("symbol").agg((F.min("low") * 0.97).alias("candle_floor"),
                                   (F.min("close") * 0.98).alias("line_lo"),
                                   (F.max("close") * 1.02).alias("line_hi"))


# ------------------------------------------------------------------ dataset / metrics

def _labelled(spark, sf):
    return D.training_window(D.labelled_rows(_features(spark, sf)))


@query("labelled_rows")
def labelled_rows(spark, sf):
    """P5: feature rows with a label (key columns + label)."""
    return D.labelled_rows(_features(spark, sf)).select("symbol", "ts", "target")


@query("training_window")
def training_window(spark, sf):
    """Labelled rows of the last 12 years before the newest row."""
    return _labelled(spark, sf).select("symbol", "ts", "target")


@query("training_window_short")
def training_window_short(spark, sf):
    """P6 with a window shorter than the data: rows are really removed."""
    return D.training_window(D.labelled_rows(_features(spark, sf)), 3).select("symbol", "ts", "target")


@query("chrono_split")
def chrono_split(spark, sf):
    """ML1/ML2: chronological split of the panel with a 10-date embargo."""
    return D.chrono_split(_labelled(spark, sf)).select("symbol", "ts", "split")


def _train(spark, sf):
    c = _ctx(spark, sf)
    return c.memo("train", lambda: materialize(
        D.chrono_split(_labelled(spark, sf)).filter(F.col("split") == "train").drop("split"), "train"))


@query("class_balance")
def class_balance(spark, sf):
    """A3: up/down counts and share for train and test."""
    s = D.chrono_split(_labelled(spark, sf)).filter(F.col("split") != "embargo")
    return _round(s.groupBy("split").agg(
        F.sum("target").cast("long").alias("n_up"),
        F.sum(1 - F.col("target")).cast("long").alias("n_down"),
        (100.0 * F.avg("target")).alias("pct_up")), r6=["pct_up"])


@query("sample_weights")
def sample_weights(spark, sf):
    """ML3: exponential-decay weights over the training dates."""
    return _round(D.sample_weights(_train(spark, sf)).select("symbol", "ts", "weight"), r6=["weight"])


@query("class_weights")
def class_weights(spark, sf):
    """ML4: balanced class weight times decay weight."""
    w = D.class_weights(D.sample_weights(_train(spark, sf)))
    return _round(w.select("symbol", "ts", "target", "class_weight", "weight"),
                  r6=["class_weight", "weight"])


@query("walk_forward_folds")
def walk_forward_folds(spark, sf):
    """ML5: 5 expanding folds with a 10-date gap (summarised per series)."""
    return D.fold_summary(D.walk_forward_folds(_train(spark, sf).select("symbol", "ts")))


@query("calibration_folds")
def calibration_folds(spark, sf):
    """ML6: calibration folds (K and gap from the number of dates)."""
    return D.fold_summary(D.calibration_folds(_train(spark, sf).select("symbol", "ts")))


def _scored(spark, sf):
    """Label vs the SMA-rule prediction on the same bar (+ P(up) score)."""
    t = target_label(spark, sf).filter(F.col("target").isNotNull()).select("symbol", "ts", "target")
    p = _predictions(spark, sf).select("symbol", "ts", "prediction", "confidence")
    j = t.join(p, ["symbol", "ts"], "inner")
    return j.withColumn("score", F.when(F.col("prediction") == 1, F.col("confidence"))
                        .otherwise(1 - F.col("confidence")))


@query("binary_metrics")
def binary_metrics(spark, sf):
    """Accuracy / precision / recall / F1 per series."""
    return _round(D.binary_metrics(_scored(spark, sf)), r6=["accuracy", "precision", "recall", "f1"])


@query("roc_auc")
def roc_auc(spark, sf):
    """Exact ROC-AUC (average ranks on ties) per series."""
    return _round(D.roc_auc(_scored(spark, sf)), r6=["roc_auc"])


@query("class_report")
def class_report(spark, sf):
    """Per-class precision / recall / F1 / support."""
    return _round(D.class_report(_scored(spark, sf)), r6=["precision", "recall", "f1"])


@query("mean_confidence")
def mean_confidence(spark, sf):
    """Mean of the row-max class probability."""
    s = _scored(spark, sf)
    return _round(s.groupBy("symbol").agg(F.avg(F.greatest("score", 1 - F.col("score")))
                                          .alias("mean_confidence")), r6=["mean_confidence"])


def _rule_folds(spark, sf):
    """Walk-forward folds with the SMA rule's prediction and score."""
    c = _ctx(spark, sf)
    return c.memo("rule_folds", lambda: materialize(
        D.walk_forward_folds(_train(spark, sf).select("symbol", "ts", "target"))
        .join(_predictions(spark, sf).select("symbol", "ts", "prediction", "confidence"), ["symbol", "ts"], "left")
        .withColumn("score", F.when(F.col("prediction") == 1, F.col("confidence")).otherwise(1 - F.col("confidence")))
        .withColumn("mk", F.concat_ws(":", "symbol", F.col("fold").cast("string"))), "folds"))


@query("cv_summary")
def cv_summary(spark, sf):
    """Mean fold precision / recall / accuracy / AUC per series; a fold
    with one class only has no AUC."""
    test = _rule_folds(spark, sf).filter("role = 'test' AND prediction IS NOT NULL")
    m = D.binary_metrics(test, by=("symbol", "fold", "mk")).join(D.roc_auc(test, by="mk", one_class=None), "mk")
    metrics = ["precision", "recall", "accuracy", "roc_auc"]
    return _round(m.groupBy("symbol").agg(*[F.avg(c).alias(c) for c in metrics]), r6=metrics)


# ------------------------------------------------------------------ run ledger (rule model)

RULE_PARAMS = '{"window": 20}'


def _rule_runs(spark, sf):
    """Run ledger of the SMA-rule model, one version per walk-forward fold.

    Version 1 carries no feature count (a run logged before the count was
    recorded), later versions record one feature.
    """
    folds = _rule_folds(spark, sf)
    test = folds.filter("role = 'test' AND prediction IS NOT NULL")
    m = D.binary_metrics(test, by=("mk",)).join(D.roc_auc(test, by="mk"), "mk")
    trained = (folds.filter(F.col("role") == "train")
               .groupBy("mk", "symbol", "fold").agg(F.max("ts").alias("_last")))
    runs = m.join(trained, "mk").select(
        F.concat(F.lit("SmaRule"), F.col("symbol"), F.lit("Classifier")).alias("model_name"),
        (F.col("fold") + 1).alias("version"),
        "accuracy", "f1", "precision", "recall", "roc_auc",
        F.when(F.col("fold") == 0, F.lit(None).cast("int")).otherwise(F.lit(1)).alias("n_features"),
        (F.datediff("_last", F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000).alias("trained_ms"),
        F.lit(RULE_PARAMS).alias("params"))
    rid = F.concat_ws(":", "model_name", F.col("version").cast("string"), F.col("trained_ms").cast("string"))
    return materialize(runs.withColumn("run_id", F.substring(F.sha2(rid, 256), 1, 16)), "runs")


RUN_METRICS = ["accuracy", "f1", "precision", "recall", "roc_auc"]


@query("model_runs")
def model_runs(spark, sf):
    """ML16: run ledger (metrics, feature count, parameters, run id, time) per version."""
    return _round(_rule_runs(spark, sf), r6=RUN_METRICS)


@query("latest_model")
def latest_model(spark, sf):
    """Newest version per model."""
    from candleflow.operators import models as ML
    return _round(ML.latest_model(_rule_runs(spark, sf)), r6=RUN_METRICS)


@query("promotion_decision")
def promotion_decision(spark, sf):
    """ML17/ML18: every run against the champion of its time."""
    from candleflow.operators import models as ML
    out = ML.promotion_decision(_rule_runs(spark, sf)).select(
        "model_name", "version", "accuracy", "f1", "roc_auc", "n_features", "params", "status", "promoted")
    return _round(out, r6=["accuracy", "f1", "roc_auc"])


@query("model_card")
def model_card(spark, sf):
    """ML19: latest run's metrics, short name, training date."""
    from candleflow.operators import models as ML
    return _round(ML.model_card(_rule_runs(spark, sf)), r6=RUN_METRICS)


# ------------------------------------------------------------------ fitted models

# What a fitted model says cannot be told by SQL: these queries return every
# key it must cover and facts that must hold for each (a probability between 0
# and 1, a confidence that belongs to it, ...).  The operators return the values.

def _model_data(spark, sf):
    from candleflow.operators import models as ML
    train, test = ML.training_sets(_features(spark, sf), PROFILE_COLS)
    return ML, materialize(train, "model_train"), materialize(test, "model_test")


def _fit_facts(ML, model, test):
    scored = materialize(model.with_probability(test).withColumn(
        "prediction", (F.col("prob_up") >= 0.5).cast("int")), "scored")
    auc = ML.evaluate(scored).first()["roc_auc"]
    return scored.select("symbol", "ts", "label", F.lit(model.n_trees).alias("n_trees"),
                         F.col("prob_up").between(0, 1).alias("in_range"), F.lit(auc > 0.5).alias("better_than_chance"))


@query("fit_forest")
def fit_forest(spark, sf):
    """ML7: extremely randomised trees at their defaults, fitted on the train
    split and scored on the test split."""
    from candleflow.operators.trees import fit_extra_trees
    ML, train, test = _model_data(spark, sf)
    return _fit_facts(ML, fit_extra_trees(train), test)


@query("extra_tree_depth2")
def extra_tree_depth2(spark, sf):
    """ML7: the first two levels of the first tree, node by node; ``path`` is
    the way from the root."""
    from candleflow.operators.trees import fit_extra_trees
    _, train, _ = _model_data(spark, sf)
    nodes = fit_extra_trees(train, {"n_estimators": 1, "max_depth": 2}).nodes()  # seven nodes at most
    paths = {0: ""}
    for i in range(len(nodes)):
        if nodes.feature[i] >= 0:
            paths[int(nodes.left[i])], paths[int(nodes.right[i])] = paths[i] + "L", paths[i] + "R"
    rows = [(paths[i], PROFILE_COLS[nodes.feature[i]] if nodes.feature[i] >= 0 else None,
             float(nodes.threshold[i]) if nodes.feature[i] >= 0 else None, float(nodes.value[i]), int(nodes.n[i]))
            for i in sorted(paths, key=paths.get)]
    out = spark.createDataFrame(rows, "path string, feature string, threshold double, value double, n long")
    return _round(out, r6=["threshold", "value"])


@query("fit_gbt")
def fit_gbt(spark, sf):
    """ML8: leaf-wise boosted trees at their defaults, fitted on the train split
    and scored on the test split."""
    from candleflow.operators.boosting import fit_boosted
    ML, train, test = _model_data(spark, sf)
    return _fit_facts(ML, fit_boosted(train), test)


#: trials of the registered search and its range of tree counts; the operator's
#: defaults are 60 trials of 100 to 1,000 trees (README)
SEARCH_TRIALS, SEARCH_TREES = 2, (20, 60)


@query("random_search")
def random_search(spark, sf):
    """ML10: trials of the search, parameters as drawn, scored by mean
    walk-forward AUC."""
    from dataclasses import replace

    from candleflow.operators import models as ML
    from candleflow.operators import search as SR
    train = ML.assemble(D.class_weights(D.sample_weights(_train(spark, sf))), PROFILE_COLS)
    trees = replace(SR.EXTRA_TREES_SPACE["n_estimators"], low=SEARCH_TREES[0], high=SEARCH_TREES[1])
    trials = SR.tune(train, n_trials=SEARCH_TRIALS, space={**SR.EXTRA_TREES_SPACE, "n_estimators": trees})
    return trials.select("trial", "n_folds", F.col("cv_roc_auc").between(0, 1).alias("in_range"))


#: (application, folder) -> where the fitted ensemble is stored
_STORED: dict[tuple[str, str], str] = {}


def _stored_model(spark, sf):
    """The calibrated ensemble of a folder's features: fitted and stored by the
    first query of an application that needs it, loaded by all, as scoring
    jobs do."""
    import uuid

    from candleflow.operators import ensemble as EN
    from candleflow.session import checkpoint_dir
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        _, train, _ = _model_data(spark, sf)
        path = f"{checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
        EN.fit_calibrated(train, PROFILE_COLS).save(spark, path)
        _STORED[key] = path
    return EN.CalibratedEnsemble.load(spark, _STORED[key])


@query("feature_importances")
def feature_importances(spark, sf):
    """ML15: every feature of the calibrated model has an importance."""
    imp = materialize(_stored_model(spark, sf).importances(spark), "importances")
    total = imp.agg(F.sum("importance")).first()[0]
    return imp.select("feature", F.col("importance").between(0, 1).alias("in_range"),
                      F.lit(abs(total - 1) < 1e-6).alias("sums_to_one"))


@query("top_importances")
def top_importances(spark, sf):
    """L4: the 15 most important features of the calibrated model."""
    from candleflow.operators import models as ML
    return ML.top_importances(_stored_model(spark, sf).importances(spark))


@query("weakest_features")
def weakest_features(spark, sf):
    """The 15 least important features, ascending."""
    from candleflow.operators import models as ML
    return ML.top_importances(_stored_model(spark, sf).importances(spark), ascending=True)


@query("importance_drop")
def importance_drop(spark, sf):
    """Features whose importance in the model is below 0.005."""
    return P.importance_drop(_stored_model(spark, sf).importances(spark))


@query("kept_features")
def kept_features(spark, sf):
    """Features kept after importance and correlation pruning."""
    imp = materialize(_stored_model(spark, sf).importances(spark), "importances")
    corr = P.corr_drop(P.corr_pairs(_features(spark, sf), PROFILE_COLS))
    return P.kept_features(imp.select("feature"), P.importance_drop(imp), corr)


def _model_scores(spark, sf):
    _, _, test = _model_data(spark, sf)
    model = _stored_model(spark, sf)
    return model, model.score(test)


@query("calibrated_scores")
def calibrated_scores(spark, sf):
    """ML11: calibrated probabilities of the test split, averaged over the folds."""
    model, scored = _model_scores(spark, sf)
    return scored.select("symbol", "ts", "label", F.lit(model.method).alias("method"),
                         F.lit(len(model.members)).alias("n_folds"), F.col("prob_up").between(0, 1).alias("in_range"))


@query("score_rows")
def score_rows(spark, sf):
    """ML12: prediction and confidence (row-max probability) for every test
    row, by the stored model."""
    _, scored = _model_scores(spark, sf)
    up = F.col("prob_up")
    fits = (F.col("prediction") == (up >= 0.5).cast("int")) & (F.col("confidence") == F.greatest(up, 1 - up)) \
        & F.col("confidence").between(0.5, 1)
    return scored.select("symbol", "ts", "label", fits.alias("consistent"))


@query("predict_latest")
def predict_latest(spark, sf):
    """ML13: the newest feature row of every series, scored by the stored model
    and upserted into the stored predictions."""
    import uuid

    from candleflow.operators import models as ML
    from candleflow.session import checkpoint_dir
    feats = _features(spark, sf)
    newest = feats.groupBy("symbol").agg(F.max("ts").alias("ts"))
    close = _ctx(spark, sf).daily.select("symbol", "ts", F.col("close").alias("entry_price"))
    scored = _stored_model(spark, sf).score(ML.assemble(feats.join(newest, ["symbol", "ts"]), PROFILE_COLS))
    new = scored.select("symbol", "ts", "prediction", "confidence", F.lit(O.HORIZON_DAYS).alias("horizon_days")) \
        .join(close, ["symbol", "ts"], "left").withColumn("scored", F.lit(True))
    store = TableStore(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    store.save("predictions", _predictions(spark, sf).withColumn("scored", F.lit(False)))
    out = store.upsert("predictions", new, ["symbol", "ts"])
    fits = F.col("confidence").between(0.5, 1) & F.col("prediction").isin(0, 1)
    return out.join(newest, ["symbol", "ts"]).select("symbol", "ts", "horizon_days", "entry_price", "scored",
                                                     fits.alias("consistent"))


# ------------------------------------------------------------------ the same operators on tables that SQL can compute

def _importances(spark, sf):
    """An importance table that both engines can compute: |corr| with the
    label.  The ranking, threshold and pruning operators take any such table."""
    corr = P.target_corr(_features(spark, sf), PROFILE_COLS)
    return corr.select("feature", F.round(F.abs("corr"), 9).alias("importance"))


@query("corr_top_features")
def corr_top_features(spark, sf):
    """L4 by |correlation|: the 15 features closest to the label."""
    from candleflow.operators import models as ML
    return ML.top_importances(_importances(spark, sf))


@query("corr_weakest_features")
def corr_weakest_features(spark, sf):
    """L7 by |correlation|: the 15 least, ascending."""
    from candleflow.operators import models as ML
    return ML.top_importances(_importances(spark, sf), ascending=True)


@query("corr_importance_drop")
def corr_importance_drop(spark, sf):
    """A12 by |correlation|: features below 0.005."""
    return P.importance_drop(_importances(spark, sf))


@query("corr_kept_features")
def corr_kept_features(spark, sf):
    """U5 by |correlation|: features kept after both prunings."""
    imp = materialize(_importances(spark, sf), "importances")
    corr = P.corr_drop(P.corr_pairs(_features(spark, sf), PROFILE_COLS))
    return P.kept_features(imp.select("feature"), P.importance_drop(imp), corr)


def _rule_scores(spark, sf):
    """Label, weight and the rule's P(up), rounded to thousandths, per split."""
    p = _predictions(spark, sf).select("symbol", "ts", "prediction", "confidence")
    raw = F.round(F.when(F.col("prediction") == 1, F.col("confidence")).otherwise(1 - F.col("confidence")), 3)
    p = p.withColumn("raw", raw)
    s = D.chrono_split(_labelled(spark, sf)).select("symbol", "ts", "target", "split")
    train = D.class_weights(D.sample_weights(s.filter("split = 'train'"))).join(p, ["symbol", "ts"])
    test = s.filter("split = 'test'").join(p, ["symbol", "ts"])
    label = F.col("target").cast("double").alias("label")
    return (materialize(train.select("symbol", "ts", label, "weight", "raw"), "rule_train"),
            materialize(test.select("symbol", "ts", label, "raw", "prediction", "confidence"), "rule_test"))


@query("rule_calibrated_scores")
def rule_calibrated_scores(spark, sf):
    """ML11: fold-wise isotonic calibration of the rule's score on the test split."""
    from candleflow.operators import models as ML
    train, test = _rule_scores(spark, sf)
    rows = test.select("symbol", "ts", "raw")
    folds = [(train.filter(role == "test").select("raw", "label", "weight"), rows)
             for role in D.calibration_roles(_train(spark, sf).select("ts"))]
    out, method = ML.calibrate(folds)
    return _round(test.select("symbol", "ts", "label").join(out, ["symbol", "ts"])
                  .withColumn("method", F.lit(method)), r6=["prob_up"])


@query("rule_score_rows")
def rule_score_rows(spark, sf):
    """ML12 on the rule's score: prediction and confidence for every test row."""
    _, test = _rule_scores(spark, sf)
    up = F.col("raw")
    return _round(test.select("symbol", "ts", (up >= 0.5).cast("int").alias("prediction"),
                              F.greatest(up, 1 - up).alias("confidence")), r6=["confidence"])


@query("rule_predict_latest")
def rule_predict_latest(spark, sf):
    """ML13 with the rule: the newest feature row of every series, scored by the model in
    production (its version is recorded), upserted into the stored predictions."""
    import uuid

    from candleflow.operators import models as ML
    from candleflow.session import checkpoint_dir
    prod = ML.promotion_decision(_rule_runs(spark, sf)).filter("status = 'production'").select(
        F.regexp_extract("model_name", "^SmaRule(.*)Classifier$", 1).alias("symbol"),
        F.col("version").cast("int").alias("model_version"))
    newest = _features(spark, sf).groupBy("symbol").agg(F.max("ts").alias("ts"))
    close = _ctx(spark, sf).daily.select("symbol", "ts", F.col("close").alias("_close"))
    new = (newest.join(_predictions(spark, sf), ["symbol", "ts"]).join(prod, "symbol")
           .join(close, ["symbol", "ts"], "left").withColumn("entry_price", F.col("_close"))
           .select(*PRED_COLS, "model_version"))
    store = TableStore(spark, f"{checkpoint_dir(spark)}/store-{uuid.uuid4().hex}")
    store.save("predictions", _predictions(spark, sf).withColumn("model_version", F.lit(None).cast("int")))
    out = store.upsert("predictions", new, ["symbol", "ts"])
    return _round(out.join(newest, ["symbol", "ts"]).select(*PRED_COLS, "model_version"), r6=["confidence"])


# ------------------------------------------------------------------ streaming

@query("stream_bars")
def stream_bars(spark, sf):
    """Section 2.13: watermark + event-time windows + foreachBatch upsert,
    run with a bounded (available-now) trigger."""
    import uuid

    from candleflow.streaming.bars_stream import run_bar_stream
    root = f"{__import__('candleflow').checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = run_bar_stream(spark, sf, TableStore(spark, f"{root}/store"), f"{root}/checkpoint")
    return out.select(*BAR_COLS)


@query("final_bars")
def final_bars(spark, sf):
    """Section 2.13 in append mode: every hour's bar once, when the watermark
    has passed it (the last hours stay open)."""
    import uuid

    from candleflow.streaming.final_bars import run_final_bar_stream
    root = f"{__import__('candleflow').checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = run_final_bar_stream(spark, sf, TableStore(spark, f"{root}/store"), f"{root}/checkpoint")
    return out.select(*BAR_COLS)


# ------------------------------------------------------------------ documented extras

LEGACY_COLS = ["sma_10", "wma_10", "momentum_10", "williams_r", "k_intraday", "d_intraday",
               "macd_hist", "adi", "bb_up", "bb_mid", "bb_low"]


@query("legacy_indicators")
def legacy_indicators(spark, sf):
    """The reference's earlier indicator set."""
    rec = recursive(spark, sf, "macd", "macd_signal").select("symbol", "bar_no", (F.col("macd") - F.col("macd_signal")).alias("macd_hist"))
    x = I.with_windows(_ctx(spark, sf).bars, [I.legacy_cols], max(I.BB_WINDOW, I.WILLIAMS_WINDOW))
    x = running_sum(x, "_mfv", "adi").drop("_mfv")
    out = x.join(rec, ["symbol", "bar_no"]).select("symbol", "ts", *LEGACY_COLS)
    return _round(out, r6=["sma_10", "wma_10", "d_intraday", "bb_up", "bb_mid", "bb_low", "adi"],
                  r4=["macd_hist"])


@query("fair_value_gaps")
def fair_value_gaps(spark, sf):
    """Three-candle imbalance zones."""
    return I.fair_value_gaps(_ctx(spark, sf).bars)


@query("gap_lifetimes")
def gap_lifetimes(spark, sf):
    """Fair-value gaps with first re-entry and fill."""
    from candleflow.operators import zones as Z
    return Z.gap_lifetimes(_ctx(spark, sf).bars)


@query("order_blocks")
def order_blocks(spark, sf):
    """Demand and supply zones at swings with first re-entry and fill."""
    from candleflow.operators import zones as Z
    return Z.order_blocks(_ctx(spark, sf).bars)


@query("timeframe_status")
def timeframe_status(spark, sf):
    """The confirmed trends of 5-minute, 15-minute and daily bars at every
    5-minute bar."""
    from candleflow.operators import timeframes as TF
    return TF.timeframe_status(S.trades_from_events(S.read_table(spark, sf, "events")))


@query("structure_features")
def structure_features(spark, sf):
    """D3: structure facts per bar, each known only after confirmation."""
    out = M.structure_features(_ctx(spark, sf).bars, _swings(spark, sf))
    return _round(out, r6=["swing_distance_high", "swing_distance_low"])


@query("interaction_features")
def interaction_features(spark, sf):
    """RSI x volume change, return ratio vs the AO series, ATR / volatility."""
    out = FT.interaction_features(_features(spark, sf), "AO")
    return _round(out, r6=["rsi_x_volume", "return_ratio", "atr_vol_ratio"])
