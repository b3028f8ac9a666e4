"""Technical indicators over a bar panel ``(symbol, ts, bar_no, open, high,
low, close, volume)``.

Three execution shapes:

* bounded windows (lags, rolling k) -> ``*_cols(df, w)`` builders that run
  inside :func:`candleflow.plans.series.over_chunks`;
* linear recurrences (EMA, Wilder smoothing) -> one
  :func:`candleflow.plans.series.linear_recurrence` pass for all of them;
* the parabolic SAR state machine -> grouped pandas kernel per symbol.

Full-window rule: a k-row statistic is NULL until k non-null inputs exist
(pandas ``min_periods = k``).  Warm-up bars of recursive indicators are NULL.
Output names are snake_case; the reference's names are noted per column.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candleflow.functions.scalar import full_window, ratio
from candleflow.plans.series import BAR, KEY, linear_recurrence, over_chunks, running_sum
from candleflow.session import materialize

# Fixed parameter values of the reference's indicator set.
TARGET_HORIZON = 10          # label looks 10 rows ahead
TARGET_THRESHOLD = 0.03      # dead zone +-3 %
EMA_WINDOWS = (10, 20)       # "EMA 10", "EMA 20"
ROC_WINDOW = 10
RSI_WINDOW = 14
MACD_FAST, MACD_SLOW, MACD_SIGN = 12, 26, 9
CCI_WINDOW, CCI_CONSTANT = 14, 0.015
CMF_WINDOW = 10
STOCH_WINDOW = 14
ADX_WINDOW = 14
BB_WINDOW, BB_DEV = 20, 2.0
ATR_WINDOW = 14
RETURN_LAGS = (1, 2, 3, 5, 10, 20)
VOL_WINDOWS = (5, 10, 20, 60)
PSAR_STEP, PSAR_MAX_STEP = 0.02, 0.20
SMA_OVERLAY = 20


def rows(w: Window, k: int) -> Window:
    """The trailing k-row frame ``[-(k-1), 0]``."""
    return w.rowsBetween(-(k - 1), 0)


def pct_change(x: Column, prev: Column) -> Column:
    """``x / prev - 1`` with x/0 -> 0 and 0/0 -> NULL (never inf/NaN)."""
    return (F.when(prev.isNull() | x.isNull(), F.lit(None).cast("double"))
            .when(prev == 0, F.when(x == 0, F.lit(None).cast("double")).otherwise(F.lit(0.0)))
            .otherwise(F.try_divide(x, prev) - 1))


# ---------------------------------------------------------------- bounded windows

def daily_return_cols(df: DataFrame, w: Window) -> DataFrame:
    """``ret`` = close.pct_change()  (lookback 1)."""
    return df.withColumn("ret", pct_change(F.col("close"), F.lag("close", 1).over(w)))


def target_cols(df: DataFrame, w: Window, horizon: int = TARGET_HORIZON,
                threshold: float = TARGET_THRESHOLD) -> DataFrame:
    """``target``: 1 if forward return > threshold, 0 if < -threshold, else NULL.

    Forward return = (close[t+h] - close[t]) / close[t]   (lookahead h).
    """
    fwd = F.try_divide(F.lead("close", horizon).over(w) - F.col("close"), F.col("close"))
    return df.withColumn("target", F.when(fwd > threshold, F.lit(1))
                         .when(fwd < -threshold, F.lit(0)).cast("int"))


def roc_cols(df: DataFrame, w: Window, k: int = ROC_WINDOW) -> DataFrame:
    """``roc`` = (C - C[-k]) / C[-k] * 100   ("ROC")."""
    prev = F.lag("close", k).over(w)
    return df.withColumn("roc", ratio(F.col("close") - prev, prev) * 100)


def lagged_return_cols(df: DataFrame, w: Window, lags=RETURN_LAGS) -> DataFrame:
    """``ret_lag{k}`` = ret shifted by k (needs ``ret``)."""
    for k in lags:
        df = df.withColumn(f"ret_lag{k}", F.lag("ret", k).over(w))
    return df


def rolling_vol_cols(df: DataFrame, w: Window, windows=VOL_WINDOWS) -> DataFrame:
    """``vol_roll{k}`` = sample std of ``ret`` over k bars (needs ``ret``)."""
    for k in windows:
        fr = rows(w, k)
        df = df.withColumn(f"vol_roll{k}", full_window("ret", fr, k, F.stddev_samp("ret").over(fr)))
    return df


def gap_return_cols(df: DataFrame, w: Window) -> DataFrame:
    """``gap_ret`` = (open - C[-1]) / C[-1]."""
    prev = F.lag("close", 1).over(w)
    return df.withColumn("gap_ret", ratio(F.col("open") - prev, prev))


def intraday_range_cols(df: DataFrame, w: Window | None = None) -> DataFrame:
    """``intraday_range`` = (high - low) / close."""
    return df.withColumn("intraday_range", ratio(F.col("high") - F.col("low"), F.col("close")))


def obv_sign_cols(df: DataFrame, w: Window) -> DataFrame:
    """``_obv_flow``: -V if close fell, else +V (first bar +V)."""
    down = F.col("close") < F.lag("close", 1).over(w)
    return df.withColumn("_obv_flow", F.when(down, -F.col("volume")).otherwise(F.col("volume")))


def stoch_k_cols(df: DataFrame, w: Window, k: int = STOCH_WINDOW) -> DataFrame:
    """``stoch_k`` = 100 (C - min L_k) / (max H_k - min L_k)   ("%K")."""
    fr = rows(w, k)
    lo, hi = F.min("low").over(fr), F.max("high").over(fr)
    return df.withColumn("stoch_k", full_window("close", fr, k,
                                                ratio(F.col("close") - lo, hi - lo) * 100))


def cci_cols(df: DataFrame, w: Window, k: int = CCI_WINDOW, c: float = CCI_CONSTANT) -> DataFrame:
    """``cci`` = (TP - mean_k TP) / (c * MAD_k TP),  TP = (H + L + C) / 3."""
    fr = rows(w, k)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    df = df.withColumn("_tp", tp).withColumn("_tpw", F.collect_list("_tp").over(fr))
    mean = F.aggregate("_tpw", F.lit(0.0), lambda a, x: a + x) / F.size("_tpw")
    df = df.withColumn("_tpm", mean)
    mad = F.aggregate("_tpw", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_tpm"))) / F.size("_tpw")
    val = ratio(F.col("_tp") - F.col("_tpm"), mad * c)
    return (df.withColumn("cci", F.when(F.size("_tpw") == k, val))
            .drop("_tp", "_tpw", "_tpm"))


def cmf_cols(df: DataFrame, w: Window, k: int = CMF_WINDOW) -> DataFrame:
    """``adosc`` = sum_k(mfv) / sum_k(V); mfv = ((C-L)-(H-C))/(H-L) * V, 0 when H = L."""
    fr = rows(w, k)
    rng = F.col("high") - F.col("low")
    mfm = F.when(rng == 0, F.lit(0.0)).otherwise(
        F.try_divide((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), rng))
    df = df.withColumn("_mfv", F.coalesce(mfm, F.lit(0.0)) * F.col("volume"))
    val = F.try_divide(F.sum("_mfv").over(fr), F.sum("volume").over(fr))
    return df.withColumn("adosc", full_window("volume", fr, k, val)).drop("_mfv")


def bollinger_cols(df: DataFrame, w: Window, k: int = BB_WINDOW, dev: float = BB_DEV) -> DataFrame:
    """``bb_pband`` = (C - lo)/(hi - lo); ``bb_width`` = (hi - lo)/mid * 100.

    mid = SMA_k, hi/lo = mid +- dev * population std.
    """
    fr = rows(w, k)
    mid, sd = F.avg("close").over(fr), F.stddev_pop("close").over(fr)
    df = df.withColumn("_mid", mid).withColumn("_hi", F.col("_mid") + dev * sd) \
           .withColumn("_lo", F.col("_mid") - dev * sd)
    df = df.withColumn("bb_pband", full_window("close", fr, k, ratio(
        F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo"))))
    df = df.withColumn("bb_width", full_window("close", fr, k, ratio(
        F.col("_hi") - F.col("_lo"), F.col("_mid")) * 100))
    return df.drop("_mid", "_hi", "_lo")


def sma_cols(df: DataFrame, w: Window, k: int = SMA_OVERLAY, out: str = "sma20") -> DataFrame:
    fr = rows(w, k)
    return df.withColumn(out, full_window("close", fr, k, F.avg("close").over(fr)))


def true_range_cols(df: DataFrame, w: Window) -> DataFrame:
    """``true_range`` = max(H-L, |H-C[-1]|, |L-C[-1]|); first bar H-L."""
    prev = F.lag("close", 1).over(w)
    hl = F.col("high") - F.col("low")
    tr = F.when(prev.isNull(), hl).otherwise(
        F.greatest(hl, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))
    return df.withColumn("true_range", tr)


def directional_move_cols(df: DataFrame, w: Window) -> DataFrame:
    """``_pdm``/``_mdm``: +DM / -DM (0 on the first bar)."""
    up = F.col("high") - F.lag("high", 1).over(w)
    down = F.lag("low", 1).over(w) - F.col("low")
    df = df.withColumn("_up", up).withColumn("_down", down)
    pdm = F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0)
    mdm = F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0)
    return df.withColumn("_pdm", pdm).withColumn("_mdm", mdm).drop("_up", "_down")


def price_move_cols(df: DataFrame, w: Window) -> DataFrame:
    """``_gain``/``_loss``: positive / negative close change, 0 on bar 0."""
    diff = F.col("close") - F.lag("close", 1).over(w)
    return (df.withColumn("_gain", F.coalesce(F.greatest(diff, F.lit(0.0)), F.lit(0.0)))
              .withColumn("_loss", F.coalesce(F.greatest(-diff, F.lit(0.0)), F.lit(0.0))))


def with_windows(df: DataFrame, builders, lookback: int, lookahead: int = 0) -> DataFrame:
    """Run several bounded builders in one (symbol, chunk) pass: one sort."""
    def fn(d, w):
        for b in builders:
            d = b(d, w)
        return d
    return over_chunks(df, fn, lookback, lookahead)


# ---------------------------------------------------------------- running / recursive

def obv(df: DataFrame) -> DataFrame:
    """``obv``: running sum of signed volume (needs ``bar_no``)."""
    staged = with_windows(df, [obv_sign_cols], 1)
    return running_sum(staged, "_obv_flow", "obv").drop("_obv_flow")


def ema_term(x: str, n: int, seed_bar: int = 0):
    """(q, c) for ``x.ewm(span=n, adjust=False)`` seeded at ``seed_bar``."""
    alpha = 2.0 / (n + 1)
    b = F.col(BAR)
    c = (F.when(b == seed_bar, F.col(x)).when(b > seed_bar, alpha * F.col(x))
         .otherwise(F.lit(0.0)))
    return 1.0 - alpha, c


def wilder_mean_term(x: str, n: int, seed_bar: int):
    """(q, c) for Wilder's average seeded by the mean of the first n values
    ending at ``seed_bar``: ``y = ((n-1) y' + x) / n``."""
    b = F.col(BAR)

    def c(w_blk):
        seed = F.avg(x).over(w_blk.rowsBetween(-(n - 1), 0))
        return (F.when(b == seed_bar, seed).when(b > seed_bar, F.col(x) / n)
                .otherwise(F.lit(0.0)))
    return (n - 1) / n, c


def wilder_sum_term(x: str, n: int, seed_bar: int):
    """(q, c) for Wilder's running sum ``s = s' - s'/n + x`` seeded by the sum
    of the n values ending at ``seed_bar``."""
    b = F.col(BAR)

    def c(w_blk):
        seed = F.sum(x).over(w_blk.rowsBetween(-(n - 1), 0))
        return (F.when(b == seed_bar, seed).when(b > seed_bar, F.col(x))
                .otherwise(F.lit(0.0)))
    return (n - 1) / n, c


def _null_before(name: str, first_bar: int) -> Column:
    return F.when(F.col(BAR) >= first_bar, F.col(name))


def _recursive_outputs(ema_windows) -> list[str]:
    return [f"ema_{k}" for k in ema_windows] + ["macd", "macd_signal", "rsi", "atr", "atr_norm",
                                                "dmi_pos", "dmi_neg", "adx"]


def recursive_inputs(bars: DataFrame, wanted=None) -> DataFrame:
    """Lagged inputs of the wanted recursive indicators (one chunk pass)."""
    wanted = set(wanted or _recursive_outputs(EMA_WINDOWS))
    builders = []
    if wanted & {"atr", "atr_norm", "dmi_pos", "dmi_neg", "adx"}:
        builders.append(true_range_cols)
    if wanted & {"dmi_pos", "dmi_neg", "adx"}:
        builders.append(directional_move_cols)
    if "rsi" in wanted:
        builders.append(price_move_cols)
    return with_windows(bars, builders, 1) if builders else bars


def recursive_indicators(staged: DataFrame, ema_windows=EMA_WINDOWS, wanted=None) -> DataFrame:
    """EMA n, MACD/signal, RSI, ATR(+norm), +DMI/-DMI, ADX (all, or ``wanted``).

    ``staged`` comes from :func:`recursive_inputs`.  The first recurrence pass
    smooths prices and moves; only MACD's signal and ADX need a second one,
    and only then is the first written.
    """
    wanted = set(wanted or _recursive_outputs(ema_windows))
    n = ADX_WINDOW
    use_macd, use_dmi = wanted & {"macd", "macd_signal"}, wanted & {"dmi_pos", "dmi_neg", "adx"}
    two_passes = wanted & {"macd_signal", "adx"}
    terms = {}
    for k in ema_windows:
        if f"ema_{k}" in wanted:
            terms[f"_ema{k}"] = ema_term("close", k)
    if use_macd:
        terms["_ema_fast"] = ema_term("close", MACD_FAST)
        terms["_ema_slow"] = ema_term("close", MACD_SLOW)
    if "rsi" in wanted:
        # ewm(alpha = 1/14, adjust=False) of gains / losses, seeded at bar 0
        a = 1.0 / RSI_WINDOW
        for src, name in (("_gain", "_au"), ("_loss", "_ad")):
            terms[name] = (1.0 - a, F.when(F.col(BAR) == 0, F.col(src)).otherwise(a * F.col(src)))
    if wanted & {"atr", "atr_norm"}:
        terms["_atr"] = wilder_mean_term("true_range", ATR_WINDOW, ATR_WINDOW - 1)
    if use_dmi:
        terms["_trs"] = wilder_sum_term("true_range", n, n)
        terms["_pdms"] = wilder_sum_term("_pdm", n, n)
        terms["_mdms"] = wilder_sum_term("_mdm", n, n)
    out = linear_recurrence(staged, terms)
    if two_passes:  # the second pass (and its carry branch) must not replay the first
        out = materialize(out, "recurrence")

    b = F.col(BAR)
    new = {f"ema_{k}": _null_before(f"_ema{k}", k - 1) for k in ema_windows if f"ema_{k}" in wanted}
    if use_macd:
        new["macd"] = F.when(b >= MACD_SLOW - 1, F.col("_ema_fast") - F.col("_ema_slow"))
    if "rsi" in wanted:
        new["rsi"] = F.when(b >= RSI_WINDOW - 1, F.when(F.col("_ad") == 0, F.lit(100.0)).otherwise(
            100.0 - 100.0 / (1.0 + F.col("_au") / F.col("_ad"))))
    if wanted & {"atr", "atr_norm"}:
        new["atr"] = _null_before("_atr", ATR_WINDOW - 1)
        new["atr_norm"] = ratio(new["atr"], F.col("close"))
    if use_dmi:
        di_ok = b >= n
        for name, move in (("_pdi", "_pdms"), ("_mdi", "_mdms")):
            new[name] = F.when(di_ok, F.when(F.col("_trs") == 0, F.lit(0.0))
                               .otherwise(100.0 * F.col(move) / F.col("_trs")))
    out = out.withColumns(new)
    if use_dmi:
        s = F.col("_pdi") + F.col("_mdi")
        out = out.withColumns({
            "_dx": F.when(di_ok, F.when(s == 0, F.lit(0.0)).otherwise(
                100.0 * F.abs(F.col("_pdi") - F.col("_mdi")) / s)),
            # DI is reported from bar n+1 (the seed bar itself is not emitted)
            "dmi_pos": F.when(b > n, F.col("_pdi")),
            "dmi_neg": F.when(b > n, F.col("_mdi"))})

    second = {}
    if "macd_signal" in wanted:
        # EMA9 of MACD seeded at the first MACD bar; warm-up inputs are zero
        out = out.withColumn("_macd0", F.coalesce("macd", F.lit(0.0)))
        second["_macd_sig"] = ema_term("_macd0", MACD_SIGN, seed_bar=MACD_SLOW - 1)
    if "adx" in wanted:
        # seed at bar 2n-1 = mean DX over bars n..2n-1
        out = out.withColumn("_dx", F.coalesce("_dx", F.lit(0.0)))
        second["_adx"] = wilder_mean_term("_dx", n, 2 * n - 1)
    if second:
        out = linear_recurrence(out, second)
    if "macd_signal" in wanted:
        out = out.withColumn("macd_signal", _null_before("_macd_sig", MACD_SLOW - 1 + MACD_SIGN - 1))
    if "adx" in wanted:
        out = out.withColumn("adx", _null_before("_adx", 2 * n - 1))
    helpers = [c for c in out.columns if c.startswith("_")]
    return out.drop(*helpers)


# ---------------------------------------------------------------- parabolic SAR

def _psar_run(high: np.ndarray, low: np.ndarray, close: np.ndarray,
              step: float = PSAR_STEP, max_step: float = PSAR_MAX_STEP, state=None):
    """Sequential SAR from the first row; returns (sar, up, ep_hi, ep_lo, af).

    With ``state`` (sar, up, ep_hi, ep_lo, af of row 1) rows 0 and 1 are the
    two bars before the first row to compute.
    """
    n = len(close)
    sar = close.astype("float64").copy()
    up_a = np.ones(n, dtype=bool)
    ehi = np.full(n, high[0] if n else np.nan, dtype="float64")
    elo = np.full(n, low[0] if n else np.nan, dtype="float64")
    afa = np.full(n, step, dtype="float64")
    up, af = True, step
    ep_hi, ep_lo = (high[0], low[0]) if n else (np.nan, np.nan)
    if state is not None:
        sar[1], up, ep_hi, ep_lo, af = state
    for i in range(2, n):
        if up:
            s = sar[i - 1] + af * (ep_hi - sar[i - 1])
            if low[i] < s:
                up, s, ep_lo, af = False, ep_hi, low[i], step
            else:
                if high[i] > ep_hi:
                    ep_hi, af = high[i], min(af + step, max_step)
                if low[i - 2] < s:
                    s = low[i - 2]
                elif low[i - 1] < s:
                    s = low[i - 1]
        else:
            s = sar[i - 1] - af * (sar[i - 1] - ep_lo)
            if high[i] > s:
                up, s, ep_hi, af = True, ep_lo, high[i], step
            else:
                if low[i] < ep_lo:
                    ep_lo, af = low[i], min(af + step, max_step)
                if high[i - 2] > s:
                    s = high[i - 2]
                elif high[i - 1] > s:
                    s = high[i - 1]
        sar[i], up_a[i], ehi[i], elo[i], afa[i] = s, up, ep_hi, ep_lo, af
    return sar, up_a, ehi, elo, afa


def _psar_kernel(high, low, close, step: float = PSAR_STEP, max_step: float = PSAR_MAX_STEP):
    return _psar_run(high, low, close, step, max_step)[0]


_PSAR_RUN_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("bar_no", T.LongType()),
    T.StructField("_run", T.LongType()), T.StructField("_home", T.BooleanType()),
    T.StructField("psar", T.DoubleType()), T.StructField("_up", T.BooleanType()),
    T.StructField("_ehi", T.DoubleType()), T.StructField("_elo", T.DoubleType()),
    T.StructField("_af", T.DoubleType()),
])

PSAR_HALO = 1024       # warm-up bars replayed before each chunk


def _psar_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bar_no")
    run = pdf["_chunk"].to_numpy()
    home = pdf["_hc"].to_numpy() == run
    first = pdf.iloc[1] if len(pdf) > 1 else None
    state = None
    if first is not None and not np.isnan(first["_s_sar"]):  # restart from the true state
        state = (first["_s_sar"], bool(first["_s_up"]), first["_s_ehi"], first["_s_elo"], first["_s_af"])
    sar, up, ehi, elo, af = _psar_run(pdf["high"].to_numpy(), pdf["low"].to_numpy(), pdf["close"].to_numpy(),
                                      state=state)
    out = pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "bar_no": pdf["bar_no"].to_numpy(),
                        "_run": run, "_home": home, "psar": sar,
                        "_up": up, "_ehi": ehi, "_elo": elo, "_af": af})
    return out if home.any() else out.iloc[:0]  # only warm-up: the series ended before this chunk


def psar(bars: DataFrame) -> DataFrame:
    """``psar`` ("SAR") joined to the bars."""
    return bars.join(psar_values(bars), [KEY, BAR], "inner")


_STATE = ["psar", "_up", "_ehi", "_elo", "_af"]


def _live(prefix: str = "") -> list:
    """What the machine goes on from: the extreme of the other trend is dead."""
    up = F.col(f"{prefix}_up")
    return [F.col(f"{prefix}psar"), up, F.when(up, F.col(f"{prefix}_ehi")).otherwise(F.col(f"{prefix}_elo")),
            F.col(f"{prefix}_af")]


def psar_values(bars: DataFrame, chunk_bars: int | None = None, halo: int = PSAR_HALO) -> DataFrame:
    """``(symbol, bar_no, psar)``: the one non-linear recursion, chunk-parallel
    and exact.

    Every (symbol, chunk) replays the state machine from ``halo`` bars before
    the chunk.  The machine is deterministic, so a chunk whose live state at
    its last warm-up bar equals the true state there (that of the chunk
    before it, chunk 0 being true from the start) is true as a whole.  The
    first chunk of a series that is not is run again from the true state;
    then the next boundary is looked at, in rounds, until all hold.  A round
    runs one chunk per series, so no task ever holds more than a chunk.
    """
    from candleflow.plans.series import _cb
    chunk = _cb(chunk_bars)
    halo = max(2, min(halo, chunk))
    b = F.col(BAR)
    home = F.floor(b / F.lit(chunk))
    pos = b - home * F.lit(chunk)
    base = bars.select(KEY, BAR, "high", "low", "close").withColumn("_hc", home)
    no_state = {f"_s_{c}": F.lit(None).cast("double") for c in ("sar", "ehi", "elo", "af")} \
        | {"_s_up": F.lit(None).cast("boolean")}
    copies = F.filter(F.array(home, F.when(pos >= chunk - halo, home + 1)), lambda v: v.isNotNull())
    staged = base.withColumns(no_state).withColumn("_chunk", F.explode(copies))
    runs = materialize(staged.groupBy(KEY, "_chunk").applyInPandas(_psar_chunk, _PSAR_RUN_SCHEMA), "psar_runs")
    while True:
        last = F.col(BAR) == (F.col("_run") + 1) * chunk - 1
        ends = runs.filter(F.col("_home") & last).select(KEY, (F.col("_run") + 1).alias("_run"), *[
            F.col(c).alias(f"_t{c}") for c in _STATE])
        spec = runs.filter(~F.col("_home") & (F.col(BAR) == F.col("_run") * chunk - 1)).drop(BAR, "_home")
        same = F.lit(True)
        for mine, true in zip(_live(), _live("_t")):
            same = same & mine.eqNullSafe(true)
        # one row per chunk: the first boundary of each series that fails
        redo = materialize(spec.join(ends, [KEY, "_run"]).filter(~same).groupBy(KEY).agg(
            F.min_by(F.struct("_run", *[f"_t{c}" for c in _STATE]), "_run").alias("_r")).select(
            KEY, F.col("_r._run").alias("_chunk"), *[F.col(f"_r._t{c}").alias(f"_t{c}") for c in _STATE]), "psar_redo")
        if redo.isEmpty():
            return runs.filter(F.col("_home")).select(KEY, BAR, "psar")
        at = redo.select(KEY, "_chunk", F.col("_tpsar").alias("_s_sar"), F.col("_t_up").alias("_s_up"),
                         F.col("_t_ehi").alias("_s_ehi"), F.col("_t_elo").alias("_s_elo"), F.col("_t_af").alias("_s_af"))
        # the chunk and the two bars before it; one small row per series to join
        near = base.withColumn("_chunk", F.explode(F.filter(F.array(
            home, F.when(pos >= chunk - 2, home + 1)), lambda v: v.isNotNull())))
        again = near.join(at, [KEY, "_chunk"]).groupBy(KEY, "_chunk").applyInPandas(_psar_chunk, _PSAR_RUN_SCHEMA)
        fixed = again.filter(F.col("_home"))
        # the boundary now holds by construction: its warm-up row takes the true state
        held = redo.select(KEY, (F.col("_chunk") * chunk - 1).alias(BAR), F.col("_chunk").alias("_run"),
                           F.lit(False).alias("_home"), *[F.col(f"_t{c}").alias(c) for c in _STATE])
        rest = runs.join(redo.select(KEY, F.col("_chunk").alias("_run")), [KEY, "_run"], "left_anti")
        runs = materialize(rest.select(*runs.columns).unionByName(fixed).unionByName(held), "psar_runs")


# ---------------------------------------------------------------- earlier indicator set

LEGACY_WINDOW = 10           # "SMA 10", "WMA 10", "Momentum 10"
WILLIAMS_WINDOW = 14
LEGACY_D_WINDOW = 3


def legacy_cols(df: DataFrame, w: Window, n: int = LEGACY_WINDOW) -> DataFrame:
    """SMA n, WMA n (weights 1..n), momentum n, Williams %R 14, intraday
    %K = 100 (C - L)/(H - L) and its 3-bar mean %D, raw Bollinger bands,
    money-flow volume for the accumulation/distribution index."""
    fr = rows(w, n)
    wsum = sum(F.lag("close", j).over(w) * float(n - j) for j in range(n))
    wr_fr = rows(w, WILLIAMS_WINDOW)
    hh, ll = F.max("high").over(wr_fr), F.min("low").over(wr_fr)
    rng = F.col("high") - F.col("low")
    d = df.withColumns({
        "sma_10": full_window("close", fr, n, F.avg("close").over(fr)),
        "wma_10": full_window("close", fr, n, wsum / float(n * (n + 1) // 2)),
        "momentum_10": F.col("close") - F.lag("close", n).over(w),
        "williams_r": full_window("close", wr_fr, WILLIAMS_WINDOW, ratio(hh - F.col("close"), hh - ll) * -100),
        "k_intraday": ratio(F.col("close") - F.col("low"), rng) * 100,
        "_mfv": F.coalesce(F.when(rng == 0, F.lit(0.0)).otherwise(F.try_divide(
            (F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), rng)), F.lit(0.0))
        * F.col("volume")})
    dfr = rows(w, LEGACY_D_WINDOW)
    bfr = rows(w, BB_WINDOW)
    mid, sd = F.avg("close").over(bfr), F.stddev_pop("close").over(bfr)
    return d.withColumns({
        "d_intraday": full_window("k_intraday", dfr, LEGACY_D_WINDOW, F.avg("k_intraday").over(dfr)),
        "bb_mid": full_window("close", bfr, BB_WINDOW, mid),
        "bb_up": full_window("close", bfr, BB_WINDOW, mid + BB_DEV * sd),
        "bb_low": full_window("close", bfr, BB_WINDOW, mid - BB_DEV * sd)})


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """Three-candle imbalance at the middle bar t.

    bullish: high[t-1] < low[t+1], zone (high[t-1], low[t+1]);
    bearish: low[t-1] > high[t+1], zone (high[t+1], low[t-1]).
    """
    def fn(d, w):
        return d.withColumns({"_h1": F.lag("high", 1).over(w), "_l1": F.lag("low", 1).over(w),
                              "_hn": F.lead("high", 1).over(w), "_ln": F.lead("low", 1).over(w)})
    x = over_chunks(bars.select(KEY, "ts", BAR, "high", "low"), fn, 1, 1)
    bull = x.filter(F.col("_h1") < F.col("_ln")).select(
        KEY, "ts", F.lit("bullish").alias("direction"), F.col("_h1").alias("gap_low"), F.col("_ln").alias("gap_high"))
    bear = x.filter(F.col("_l1") > F.col("_hn")).select(
        KEY, "ts", F.lit("bearish").alias("direction"), F.col("_hn").alias("gap_low"), F.col("_l1").alias("gap_high"))
    return bull.unionByName(bear)
