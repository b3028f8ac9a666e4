"""DuckDB oracle statements, one per value-checkable query key.

Tables available as views: the driver tables (``lineitem``, ``events``, ...).
Every statement recomputes its input bars from ``lineitem``/``events``.
"""

from __future__ import annotations

from candleflow.operators import timeframes as TF
from candleflow.operators import trees as T
from candleflow.plans.sqltext import (DAILY_BARS, HOURLY_BARS, PSAR, REC_INPUTS, cubic_sql,
                                      pct_change, ratio, rounded)
from candleflow.queries import SEARCH_TRIALS

SQL: dict[str, str] = {}

W = "WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)"


def frame(k: int) -> str:
    return f"(PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def with_bars(body: str, extra: str = "") -> str:
    return f"WITH {DAILY_BARS}{(',' + extra) if extra else ''}\n{body}"


# ------------------------------------------------------------------ sources

SQL["scan_bars"] = """
SELECT l_returnflag || l_linestatus AS symbol, CAST(l_shipdate AS DATE) AS ts,
       l_extendedprice / l_quantity AS price, l_quantity AS qty
FROM lineitem"""

SQL["ohlcv_bars"] = with_bars("SELECT symbol, ts, open, high, low, close, volume FROM bars")

SQL["ohlcv_bars_hourly"] = f"WITH {HOURLY_BARS}\nSELECT symbol, ts, open, high, low, close, volume FROM hbars"

SQL["recent_bars"] = with_bars("""
SELECT symbol, ts, open, high, low, close, volume FROM bars
WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 12 MONTH""")

SQL["latest_rows"] = with_bars("""
SELECT symbol, ts, open, high, low, close, volume FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) t
WHERE rn <= 5""")

SQL["drop_tail"] = with_bars("""
SELECT symbol, ts, open, high, low, close, volume FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM bars) t
WHERE rn > 10""")

# ------------------------------------------------------------------ windows

SQL["target_label"] = with_bars(f"""
SELECT symbol, ts, close,
       CAST(CASE WHEN (lead(close, 10) OVER w - close) / close > 0.03 THEN 1
                 WHEN (lead(close, 10) OVER w - close) / close < -0.03 THEN 0 END AS INTEGER) AS target
FROM b {W}""")

RET = pct_change("close", "lag(close) OVER w")

SQL["daily_return"] = rounded(with_bars(f"SELECT symbol, ts, {RET} AS ret FROM b {W}"), )

SQL["roc"] = rounded(with_bars(f"""
SELECT symbol, ts, {ratio('close - lag(close, 10) OVER w', 'lag(close, 10) OVER w')} * 100 AS roc
FROM b {W}"""), )

RET_CTE = f"""
r AS (SELECT symbol, ts, bar_no, {RET} AS ret FROM b {W})"""

LAGS = (1, 2, 3, 5, 10, 20)
VOLS = (5, 10, 20, 60)

SQL["lagged_returns"] = rounded(with_bars(
    "SELECT symbol, ts, " + ", ".join(f"lag(ret, {k}) OVER w AS ret_lag{k}" for k in LAGS) +
    f" FROM r {W}", RET_CTE), )

SQL["rolling_vol"] = rounded(with_bars(
    "SELECT symbol, ts, " + ", ".join(
        f"CASE WHEN count(ret) OVER {frame(k)} = {k} THEN stddev_samp(ret) OVER {frame(k)} END AS vol_roll{k}"
        for k in VOLS) + " FROM r", RET_CTE), r6=[f"vol_roll{k}" for k in VOLS])

SQL["gap_return"] = rounded(with_bars(f"""
SELECT symbol, ts, {ratio('open - lag(close) OVER w', 'lag(close) OVER w')} AS gap_ret FROM b {W}"""),
    )

SQL["intraday_range"] = rounded(with_bars(
    f"SELECT symbol, ts, {ratio('high - low', 'close')} AS intraday_range FROM bars"),
    )

SQL["obv"] = with_bars(f"""
SELECT symbol, ts, sum(CASE WHEN close < lag_c THEN -volume ELSE volume END)
       OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS obv
FROM (SELECT *, lag(close) OVER w AS lag_c FROM b {W}) t""")

SQL["stoch_k"] = rounded(with_bars(f"""
SELECT symbol, ts,
  CASE WHEN count(close) OVER {frame(14)} = 14 THEN
    {ratio(f'close - min(low) OVER {frame(14)}', f'max(high) OVER {frame(14)} - min(low) OVER {frame(14)}')} * 100
  END AS stoch_k
FROM b"""), )

SQL["cci"] = rounded(with_bars(f"""
SELECT symbol, ts,
  CASE WHEN len(tpw) = 14 THEN
    {ratio('tp - tpm', 'list_sum(list_transform(tpw, lambda v: abs(v - tpm))) / len(tpw) * 0.015')}
  END AS cci
FROM (SELECT symbol, ts, tp, tpw, list_sum(tpw) / len(tpw) AS tpm FROM (
        SELECT symbol, ts, tp, list(tp) OVER {frame(14)} AS tpw
        FROM (SELECT *, (high + low + close) / 3.0 AS tp FROM b) t0) t1) t2"""), r6=["cci"])

SQL["cmf"] = rounded(with_bars(f"""
SELECT symbol, ts,
  CASE WHEN count(volume) OVER {frame(10)} = 10 THEN
    sum(mfv) OVER {frame(10)} / sum(volume) OVER {frame(10)} END AS adosc
FROM (SELECT *, (CASE WHEN high = low THEN 0.0
                 ELSE ((close - low) - (high - close)) / (high - low) END) * volume AS mfv FROM b) t"""),
    r6=["adosc"])

BB_CTE = f"""
bb AS (
  SELECT symbol, ts, close, cnt, mid, mid + 2.0 * sd AS hi, mid - 2.0 * sd AS lo FROM (
    SELECT symbol, ts, close, count(close) OVER {frame(20)} AS cnt,
           avg(close) OVER {frame(20)} AS mid, stddev_pop(close) OVER {frame(20)} AS sd FROM b) t)"""

SQL["bb_pband"] = rounded(with_bars(
    f"SELECT symbol, ts, CASE WHEN cnt = 20 THEN {ratio('close - lo', 'hi - lo')} END AS bb_pband FROM bb",
    BB_CTE), r6=["bb_pband"])

SQL["bb_width"] = rounded(with_bars(
    f"SELECT symbol, ts, CASE WHEN cnt = 20 THEN {ratio('hi - lo', 'mid')} * 100 END AS bb_width FROM bb",
    BB_CTE), r6=["bb_width"])

SQL["sma20"] = rounded(with_bars(f"""
SELECT symbol, ts, CASE WHEN count(close) OVER {frame(20)} = 20 THEN avg(close) OVER {frame(20)} END AS sma20
FROM b"""), r6=["sma20"])

SQL["true_range"] = rounded(with_bars(f"""
SELECT symbol, ts, CASE WHEN pc IS NULL THEN high - low
                        ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS true_range
FROM (SELECT *, lag(close) OVER w AS pc FROM b {W}) t"""), )

# ------------------------------------------------------------------ recursive

REC = "RECURSIVE " + DAILY_BARS + "," + REC_INPUTS


def with_rec(body: str) -> str:
    return f"WITH {REC}\n{body}"


SQL["ema"] = rounded(with_rec("SELECT symbol, ts, ema_10, ema_20 FROM recind"), r4=["ema_10", "ema_20"])
SQL["macd"] = rounded(with_rec("SELECT symbol, ts, macd, macd_signal FROM recind"),
                      r4=["macd", "macd_signal"])
SQL["rsi"] = rounded(with_rec("SELECT symbol, ts, rsi FROM recind"), r4=["rsi"])
SQL["atr"] = rounded(with_rec("SELECT symbol, ts, atr, atr_norm FROM recind"), r4=["atr"], r6=["atr_norm"])
SQL["dmi"] = rounded(with_rec("SELECT symbol, ts, dmi_pos, dmi_neg FROM recind"),
                     r4=["dmi_pos", "dmi_neg"])
SQL["adx"] = rounded(with_rec("SELECT symbol, ts, adx FROM recind"), r4=["adx"])
SQL["psar"] = f"WITH RECURSIVE {DAILY_BARS},{PSAR}\nSELECT symbol, ts, psar FROM psar"

# ------------------------------------------------------------------ panel / features

from candleflow.plans.sqltext import BOUNDED, SURVIVING, feature_sql, side_panel_sql  # noqa: E402

SIDE = ["AO", "NF", "NO", "RF", "RO"]
SIDE_COLS = [f"{s}_close" for s in SIDE]

SQL["close_panel"] = with_bars("SELECT a.ts, a.close AS AF_close, panel.* EXCLUDE (ts) "
                               "FROM (SELECT ts, close FROM bars WHERE symbol = 'AF') a "
                               "LEFT JOIN panel USING (ts)", side_panel_sql(SIDE))

LONG = """
lp AS (
  SELECT g.symbol, g.ts, s.close, row_number() OVER (PARTITION BY g.symbol ORDER BY g.ts) - 1 AS pos
  FROM (SELECT a.ts, v.symbol FROM (SELECT ts FROM bars WHERE symbol = 'AF') a
        CROSS JOIN (VALUES ('AO'), ('NF'), ('NO'), ('RF'), ('RO')) v(symbol)) g
  LEFT JOIN bars s USING (symbol, ts)
)"""

SQL["ffill"] = with_bars("""
SELECT symbol, ts, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos
       ROWS UNBOUNDED PRECEDING) AS close FROM lp""", LONG)

SQL["bfill"] = with_bars("""
SELECT symbol, ts, first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY pos
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM lp""", LONG)

SQL["interpolate_linear"] = rounded(with_bars("""
SELECT symbol, ts,
       CASE WHEN close IS NOT NULL THEN close
            WHEN pv IS NULL THEN NULL
            WHEN nv IS NULL THEN pv
            ELSE pv + (nv - pv) * ((pos - pp) / (np - pp)) END AS close
FROM (SELECT symbol, ts, close, pos,
        last_value(close IGNORE NULLS) OVER wf AS pv,
        last_value(CASE WHEN close IS NOT NULL THEN CAST(pos AS DOUBLE) END IGNORE NULLS) OVER wf AS pp,
        first_value(close IGNORE NULLS) OVER wb AS nv,
        first_value(CASE WHEN close IS NOT NULL THEN CAST(pos AS DOUBLE) END IGNORE NULLS) OVER wb AS np
      FROM lp
      WINDOW wf AS (PARTITION BY symbol ORDER BY pos ROWS UNBOUNDED PRECEDING),
             wb AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) t""",
    LONG))

SQL["interpolate_cubic"] = with_bars("""
SELECT c.symbol, c.ts, coalesce(lp.close, round(c.close, 5)) AS close FROM cubic c JOIN lp USING (symbol, ts)""",
                                     LONG + "," + cubic_sql("lp")).replace("WITH ", "WITH RECURSIVE ", 1)

FEAT = "RECURSIVE " + DAILY_BARS + "," + REC_INPUTS + "," + PSAR + "," + BOUNDED + "," + SURVIVING

SQL["align_panel"] = f"WITH {FEAT}, {side_panel_sql(SIDE)}\n" \
    f"SELECT symbol, ts, {', '.join(SIDE_COLS)} FROM surv LEFT JOIN panel USING (ts)"

STAT = ["close", "volume"] + __import__("candleflow.plans.sqltext", fromlist=["x"]).INDICATOR_COLS

SQL["stationary"] = rounded(f"""WITH {FEAT},
pv AS (SELECT surv.*, close AS lvl, lag(close) OVER w AS p_close, lag(volume) OVER w AS p_volume,
              lag(obv) OVER w AS p_obv FROM surv WINDOW w AS (PARTITION BY symbol ORDER BY sbar)),
st AS (
  SELECT symbol, ts, {pct_change('close', 'p_close')} AS close, {pct_change('volume', 'p_volume')} AS volume,
         {ratio('ema_10 - lvl', 'lvl')} AS ema_10, {ratio('ema_20 - lvl', 'lvl')} AS ema_20,
         {ratio('psar - lvl', 'lvl')} AS psar, {ratio('macd', 'lvl')} AS macd,
         {ratio('macd_signal', 'lvl')} AS macd_signal, {ratio('obv - p_obv', 'lvl')} AS obv,
         {', '.join(c for c in STAT if c not in ('close', 'volume', 'ema_10', 'ema_20', 'psar', 'macd', 'macd_signal', 'obv'))}
  FROM pv)
SELECT symbol, ts, {', '.join(STAT)} FROM st WHERE {' AND '.join(f'{c} IS NOT NULL' for c in STAT)}""",
    r6=STAT)

FEATURE_SQL = f"WITH {FEAT}, {feature_sql(SIDE)}\nSELECT * FROM feat"

SQL["feature_table"] = rounded(FEATURE_SQL, r6=STAT + SIDE_COLS)

SQL["feature_table_filled"] = rounded(
    f"WITH {FEAT}, {feature_sql(SIDE, ['RO_close'], 'cubic')}\nSELECT * FROM feat", r6=STAT + SIDE_COLS)

_FEATURE_NAMES = sorted(["symbol", "ts"] + STAT + SIDE_COLS + ["target"])
_JSON = "[" + ", ".join(f'"{c}"' for c in _FEATURE_NAMES) + "]"

SQL["manifest_hash"] = f"""WITH {FEAT}, {feature_sql(SIDE)}
SELECT '{_JSON}' AS columns_json, {len(_FEATURE_NAMES)} AS n_columns, count(*) AS row_count,
       substr(sha256('{_JSON}'), 1, 16) AS column_hash
FROM feat"""

# ------------------------------------------------------------------ market structure

from candleflow.plans.sqltext import SIGNALS, swings_sql  # noqa: E402

SQL["atr_days"] = rounded(with_rec(f"""
SELECT symbol, ts, atr_ratio, close >= open AS is_up, atr_ratio >= 2.0 AS double_atr,
       atr_ratio >= 1.0 AND atr_ratio < 2.0 AS single_atr
FROM (SELECT recind.symbol, recind.ts, b.open, b.close, {ratio('b.high - b.low', 'recind.atr')} AS atr_ratio
      FROM recind JOIN b USING (symbol, bar_no)) t"""), r6=["atr_ratio"])

SQL["atr_double_days"] = rounded(with_rec(f"""
SELECT symbol, ts, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction, close, atr_ratio
FROM (SELECT recind.symbol, recind.ts, b.open, b.close, {ratio('b.high - b.low', 'recind.atr')} AS atr_ratio
      FROM recind JOIN b USING (symbol, bar_no)) t WHERE atr_ratio >= 2.0"""), r6=["atr_ratio"])

SW = swings_sql()

SQL["swing_points"] = with_bars("SELECT symbol, ts, price, swing_type FROM raw", SW)
SQL["swings_clean"] = with_bars("SELECT symbol, ts, price, swing_type FROM cl", SW)
SQL["swing_labels"] = with_bars("SELECT symbol, ts, swing_type, price, label FROM sw", SW)
SQL["swing_sequences"] = with_bars("SELECT symbol, ts, swing_type, label, seq_count, seq_dir FROM sw", SW)
SQL["swing_trend"] = with_bars("SELECT symbol, ts, swing_type, label, trend FROM sw", SW)
SQL["zigzag_segments"] = with_bars("""
SELECT symbol, prev_ts AS from_ts, prev_price AS from_price, ts AS to_ts, price AS to_price, trend
FROM sw WHERE prev_ts IS NOT NULL""", SW)
SQL["prevailing_trend"] = with_bars("SELECT symbol, ts, swing_type, label, state_before FROM sw", SW)
SQL["structure_signals"] = with_bars("SELECT * FROM signals", SW + "," + SIGNALS)
SQL["choch_signals"] = with_bars("SELECT * FROM signals WHERE type = 'choch'", SW + "," + SIGNALS)
SQL["seq3_signals"] = with_bars("SELECT symbol, ts, price, label, seq_dir FROM sw WHERE seq_count = 3", SW)

WEEKLY = """
wbars AS (
  SELECT l_returnflag || l_linestatus AS symbol,
         CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE) AS ts,
         first(l_extendedprice / l_quantity ORDER BY CAST(l_shipdate AS DATE), l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open,
         max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity ORDER BY CAST(l_shipdate AS DATE), l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close
  FROM lineitem GROUP BY 1, 2
),
wb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM wbars)"""

SQL["multi_tf_structure"] = with_bars(f"""
SELECT '1d' AS timeframe, symbol, ts, swing_type, price, label, trend FROM sw
UNION ALL
SELECT '1w' AS timeframe, symbol, ts, swing_type, price, label, trend FROM w_sw""",
    SW + "," + WEEKLY + "," + swings_sql("wb", 3, "w_"))

# ------------------------------------------------------------------ predictions / outcomes

PREDS = """
sm AS (SELECT b.*, CASE WHEN count(close) OVER f20 = 20 THEN avg(close) OVER f20 END AS sma20
       FROM b WINDOW f20 AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
preds AS (
  SELECT symbol, ts, CAST(close > sma20 AS INTEGER) AS prediction,
         least(greatest(0.5 + abs(close / sma20 - 1), 0.5), 1.0) AS confidence,
         10 AS horizon_days,
         CASE WHEN bar_no % 3 <> 0 THEN close END AS entry_price
  FROM sm WHERE sma20 IS NOT NULL
),
outc AS (
  SELECT p.symbol, p.ts AS date, CASE WHEN prediction = 1 THEN 'UP' ELSE 'DOWN' END AS direction,
         p.confidence, coalesce(p.entry_price, ab.close) AS entry_price,
         CASE WHEN x.close IS NOT NULL AND coalesce(p.entry_price, ab.close) IS NOT NULL THEN x.close END AS exit_price,
         CASE WHEN x.close IS NOT NULL THEN (x.close - coalesce(p.entry_price, ab.close)) / coalesce(p.entry_price, ab.close) END AS return_pct,
         CASE WHEN x.close IS NOT NULL THEN x.close - coalesce(p.entry_price, ab.close) END AS pnl,
         CASE WHEN x.close IS NOT NULL THEN (p.prediction = 1) = (x.close > coalesce(p.entry_price, ab.close)) END AS correct,
         CASE WHEN x.close IS NOT NULL AND coalesce(p.entry_price, ab.close) IS NOT NULL THEN 'closed' ELSE 'open' END AS status
  FROM (SELECT *, CAST(ts + INTERVAL 10 DAY AS DATE) AS probe FROM preds) p
  LEFT JOIN bars ab ON ab.symbol = p.symbol AND ab.ts = p.ts
  ASOF LEFT JOIN bars x ON x.symbol = p.symbol AND x.ts >= p.probe
)"""

PRED_COLS = "symbol, ts, prediction, round(confidence, 6) AS confidence, horizon_days, entry_price"

SQL["predictions"] = with_bars(f"SELECT {PRED_COLS} FROM preds", PREDS)
SQL["prediction_outcomes"] = rounded(with_bars("SELECT * FROM outc", PREDS), r6=["confidence"])
# the same statements over hourly bars; the probe keeps the time of day
_HOURLY = (HOURLY_BARS + ", bars AS (SELECT * FROM hbars), b AS (SELECT *, row_number() OVER "
           "(PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM bars)," + PREDS
           .replace("CAST(ts + INTERVAL 10 DAY AS DATE)", "ts + INTERVAL 10 DAY"))
SQL["hourly_outcomes"] = rounded(f"WITH {_HOURLY}\nSELECT * FROM outc", r6=["confidence"])

SQL["pnl_summary"] = rounded(with_bars("""
SELECT symbol, sum(pnl) AS total_pnl, avg(CAST(correct AS DOUBLE)) AS accuracy, avg(return_pct) AS avg_return,
       count(*) AS n_closed
FROM outc WHERE status = 'closed' GROUP BY symbol""", PREDS), r6=["total_pnl", "accuracy", "avg_return"])


def _money(x: str, signed: bool = False) -> str:
    cents = f"CAST(floor(abs({x}) * 100 + 0.5) AS BIGINT)"
    sign = f"CASE WHEN {x} < 0 THEN '-' ELSE '{'+' if signed else ''}' END"
    return (f"('$' || {sign} || format('{{:,}}', CAST(floor({cents} / 100) AS BIGINT)) || '.' || "
            f"lpad(CAST({cents} % 100 AS VARCHAR), 2, '0'))")


def _pct(x: str) -> str:
    bp = f"CAST(floor(abs({x}) * 10000 + 0.5) AS BIGINT)"
    return (f"((CASE WHEN {x} < 0 THEN '-' ELSE '+' END) || CAST({bp} // 100 AS VARCHAR) || '.' || "
            f"lpad(CAST({bp} % 100 AS VARCHAR), 2, '0') || '%')")


LABEL = ("CASE WHEN confidence >= 0.70 THEN 'Strong' WHEN confidence >= 0.60 THEN 'Moderate' "
         "ELSE 'Weak' END")

SQL["results_table"] = with_bars(f"""
SELECT symbol, strftime(date, '%Y-%m-%d') AS date, direction,
       CAST(CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% ' || {LABEL} AS confidence,
       CASE WHEN entry_price IS NULL THEN '-' ELSE {_money('entry_price')} END AS entry,
       CASE WHEN exit_price IS NULL THEN 'pending' ELSE {_money('exit_price')} END AS exit,
       CASE WHEN return_pct IS NULL THEN '-' ELSE {_pct('return_pct')} END AS return_pct,
       CASE WHEN pnl IS NULL THEN '-' ELSE {_money('pnl', True)} END AS pnl,
       CASE WHEN status = 'open' THEN 'open' WHEN correct THEN 'right' ELSE 'wrong' END AS result
FROM outc ORDER BY date DESC, symbol""", PREDS)

SQL["confidence_label"] = with_bars(
    f"SELECT symbol, ts, round(confidence, 6) AS confidence, {LABEL} AS label FROM preds", PREDS)
SQL["position_size"] = with_bars(
    "SELECT symbol, ts, round(confidence, 6) AS confidence, CASE WHEN confidence >= 0.70 THEN 1.0 "
    "WHEN confidence >= 0.60 THEN 0.5 ELSE 0.0 END AS position FROM preds", PREDS)
SQL["prediction_markers"] = with_bars("""
SELECT p.symbol, p.ts, CASE WHEN prediction = 1 THEN 'up' ELSE 'down' END AS marker, bars.close
FROM preds p JOIN bars USING (symbol, ts)""", PREDS)
SQL["visible_predictions"] = with_bars(f"""
SELECT p.symbol, p.ts, p.prediction, round(p.confidence, 6) AS confidence
FROM preds p JOIN (SELECT symbol, min(ts) AS first_ts FROM bars
                   WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 6 MONTH GROUP BY symbol) f
  ON f.symbol = p.symbol AND p.ts >= f.first_ts""", PREDS)

NEW_BATCH = """
sm10 AS (SELECT b.*, CASE WHEN count(close) OVER f10 = 10 THEN avg(close) OVER f10 END AS sma10
         FROM b WINDOW f10 AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
newp AS (
  SELECT symbol, ts, CAST(close > sma10 AS INTEGER) AS prediction,
         least(greatest(0.5 + abs(close / sma10 - 1), 0.5), 1.0) AS confidence,
         10 AS horizon_days, CASE WHEN bar_no % 3 <> 0 THEN close END AS entry_price
  FROM sm10 WHERE sma10 IS NOT NULL
),
merged AS (
  SELECT symbol, ts, arg_max(prediction, arrival) AS prediction, arg_max(confidence, arrival) AS confidence,
         arg_max(horizon_days, arrival) AS horizon_days,
         arg_max(struct_pack(e := entry_price), arrival).e AS entry_price
  FROM (SELECT *, 1 AS arrival FROM preds UNION ALL SELECT *, 2 AS arrival FROM newp) u
  GROUP BY symbol, ts
)"""

SQL["dedupe_last"] = with_bars(f"SELECT {PRED_COLS} FROM merged", PREDS + "," + NEW_BATCH)
SQL["upsert_predictions"] = SQL["dedupe_last"]

# ------------------------------------------------------------------ profiling

from itertools import combinations  # noqa: E402

from candleflow.operators.profile import feature_groups  # noqa: E402

PROFILE = STAT + SIDE_COLS
DESCRIBE = ["rsi", "roc", "macd", "cci", "adx", "dmi_pos", "dmi_neg", "stoch_k", "obv", "adosc"]


def with_feat(body: str, extra: str = "") -> str:
    return f"WITH {FEAT}, {feature_sql(SIDE)}{(',' + extra) if extra else ''}\n{body}"


def unpivot(cols, src="feat") -> str:
    return f"(UNPIVOT (SELECT {', '.join(cols)} FROM {src}) ON {', '.join(cols)} INTO NAME feature VALUE value)"


SQL["target_counts"] = with_feat("SELECT target, count(*) AS n FROM feat GROUP BY target")

SQL["dead_zone_stats"] = rounded(with_bars(f"""
SELECT symbol, count(*) AS n_rows, count_if(target IS NULL) AS n_dead,
       100.0 * count_if(target IS NULL) / count(*) AS pct_dead
FROM (SELECT symbol, CASE WHEN (lead(close, 10) OVER w - close) / close > 0.03 THEN 1
                          WHEN (lead(close, 10) OVER w - close) / close < -0.03 THEN 0 END AS target
      FROM b {W}) t GROUP BY symbol"""), r6=["pct_dead"])

_PANEL_COLS = ["AF_close"] + SIDE_COLS
SQL["data_quality"] = with_bars(f"""
SELECT count(*) AS n_rows, sum({' + '.join(f'CAST({c} IS NULL AS BIGINT)' for c in ['ts'] + _PANEL_COLS)}) AS null_total,
       count(*) - count(DISTINCT ts) AS dup_keys, min(ts) AS min_ts, max(ts) AS max_ts,
       6 AS n_double_cols, 1 AS n_other_cols
FROM (SELECT a.ts, a.close AS AF_close, panel.* EXCLUDE (ts)
      FROM (SELECT ts, close FROM bars WHERE symbol = 'AF') a LEFT JOIN panel USING (ts)) p""",
    side_panel_sql(SIDE))

SQL["describe_indicators"] = rounded(with_feat(f"""
SELECT feature, count(value) AS count, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50,
       quantile_cont(value, 0.75) AS p75, max(value) AS max
FROM {unpivot(DESCRIBE)} u WHERE value IS NOT NULL GROUP BY feature"""),
    r2=["mean", "std", "min", "p25", "p50", "p75", "max"])

_GROUPS = ", ".join(f"('{g}', '{c}')" for g, cs in feature_groups(PROFILE).items() for c in cs)
SQL["feature_ranges"] = rounded(with_feat(f"""
SELECT g.grp, s.feature, s.min, s.max, s.mean, s.std, s.max - s.min AS range
FROM (SELECT feature, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std
      FROM {unpivot(PROFILE)} u GROUP BY feature) s
JOIN (VALUES {_GROUPS}) g(grp, feature) USING (feature)"""), r2=["min", "max", "mean", "std", "range"])

SQL["range_extremes"] = rounded(with_feat(f"""
SELECT kind, CAST(rk AS INTEGER) AS rank, feature, range, ratio FROM (
  SELECT 'largest' AS kind, hi AS rk, * FROM rg WHERE hi <= 5
  UNION ALL
  SELECT 'smallest' AS kind, lo AS rk, * FROM rg WHERE lo <= 5) t""", f"""
rg0 AS (SELECT feature, max(value) - min(value) AS range FROM {unpivot(PROFILE)} u GROUP BY feature),
rg AS (SELECT *, max(range) OVER () / min(range) OVER () AS ratio,
             row_number() OVER (ORDER BY range DESC, feature) AS hi,
             row_number() OVER (ORDER BY range ASC, feature) AS lo FROM rg0)"""), r6=["range"], r2=["ratio"])

SQL["target_corr"] = rounded(with_feat(f"""
SELECT feature, corr(value, t) AS corr FROM (
  UNPIVOT (SELECT {', '.join(PROFILE)}, CAST(target AS DOUBLE) AS t FROM feat)
  ON {', '.join(PROFILE)} INTO NAME feature VALUE value) u
WHERE value IS NOT NULL AND t IS NOT NULL GROUP BY feature"""), r6=["corr"])

_PAIRS = list(combinations(PROFILE, 2))
CORR_CTE = f"""
cw AS (SELECT {', '.join(f'abs(corr({a}, {b})) AS "{a}|{b}"' for a, b in _PAIRS)} FROM feat),
cp AS (SELECT split_part(name, '|', 1) AS feature_a, split_part(name, '|', 2) AS feature_b, corr
       FROM (UNPIVOT cw ON COLUMNS(*) INTO NAME name VALUE corr) u WHERE corr > 0.9)"""
SQL["corr_pairs"] = rounded(with_feat("SELECT * FROM cp", CORR_CTE), r3=["corr"])
SQL["corr_pairs_gaps"] = rounded(with_bars(" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, regr_count({a}, {b}) AS n, corr({a}, {b}) AS corr FROM cpanel"
    for a, b in combinations(_PANEL_COLS, 2)), side_panel_sql(SIDE) + """,
cpanel AS (SELECT a.ts, a.close AS AF_close, panel.* EXCLUDE (ts)
           FROM (SELECT ts, close FROM bars WHERE symbol = 'AF') a LEFT JOIN panel USING (ts))"""), r6=["corr"])
SQL["corr_drop"] = with_feat("SELECT DISTINCT feature_b AS feature FROM cp", CORR_CTE)

SQL["price_bounds"] = with_bars("""
SELECT symbol, min(low) * 0.97 AS candle_floor, min(close) * 0.98 AS line_lo, max(close) * 1.02 AS line_hi
FROM bars WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 6 MONTH GROUP BY symbol""")

# ------------------------------------------------------------------ dataset / metrics

LAB = """
lab AS (SELECT * FROM feat WHERE target IS NOT NULL
        AND ts >= (SELECT max(ts) FROM feat WHERE target IS NOT NULL) - INTERVAL 144 MONTH),
cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n
        FROM (SELECT DISTINCT ts FROM lab) d),
spl AS (
  SELECT lab.*, CASE WHEN pos >= n - ceil(n * 0.2) THEN 'test'
                     WHEN pos >= n - ceil(n * 0.2) - 10 THEN 'embargo' ELSE 'train' END AS split
  FROM lab JOIN cal USING (ts)
),
tcal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS tpos, count(*) OVER () AS m
         FROM (SELECT DISTINCT ts FROM spl WHERE split = 'train') d),
tr AS (SELECT spl.*, tpos, m FROM spl JOIN tcal USING (ts) WHERE split = 'train'),
wt AS (
  SELECT *, w / avg(w) OVER () AS weight FROM (
    SELECT *, exp(-m / greatest(floor(m * 0.33), 1.0)
                  + tpos * CASE WHEN m > 1 THEN (m / greatest(floor(m * 0.33), 1.0)) / (m - 1) ELSE 0 END) AS w
    FROM tr) t
)"""

SQL["labelled_rows"] = with_feat("SELECT symbol, ts, target FROM feat WHERE target IS NOT NULL")
SQL["training_window"] = with_feat("SELECT symbol, ts, target FROM lab", LAB)
SQL["training_window_short"] = with_feat("""SELECT symbol, ts, target FROM feat WHERE target IS NOT NULL
  AND ts >= (SELECT max(ts) FROM feat WHERE target IS NOT NULL) - INTERVAL 36 MONTH""")
SQL["chrono_split"] = with_feat("SELECT symbol, ts, split FROM spl", LAB)
SQL["class_balance"] = rounded(with_feat("""
SELECT split, CAST(sum(target) AS BIGINT) AS n_up, CAST(sum(1 - target) AS BIGINT) AS n_down,
       100.0 * avg(target) AS pct_up
FROM spl WHERE split <> 'embargo' GROUP BY split""", LAB), r6=["pct_up"])
SQL["sample_weights"] = rounded(with_feat("SELECT symbol, ts, weight FROM wt", LAB), r6=["weight"])
SQL["class_weights"] = rounded(with_feat("""
SELECT symbol, ts, target, cw AS class_weight, weight * cw AS weight FROM (
  SELECT *, count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY target)) AS cw
  FROM wt) t""", LAB), r6=["class_weight", "weight"])


def _fold_sql(k: str, gap: str) -> str:
    return f"""
SELECT symbol, fold, role, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS max_ts_ FROM (
  SELECT symbol, ts, fold,
         CASE WHEN tpos >= m - ({k} - fold) * floor(m / ({k} + 1))
                   AND tpos < m - ({k} - fold) * floor(m / ({k} + 1)) + floor(m / ({k} + 1)) THEN 'test'
              WHEN tpos < m - ({k} - fold) * floor(m / ({k} + 1)) - {gap} THEN 'train' END AS role
  FROM (SELECT *, {k} AS kk FROM tr) t, range(0, 5) r(fold) WHERE fold < {k}) x
WHERE role IS NOT NULL GROUP BY symbol, fold, role"""


SQL["walk_forward_folds"] = with_feat(_fold_sql("5", "10").replace("max_ts_", "last_ts"), LAB)
SQL["calibration_folds"] = with_feat(
    _fold_sql("(CASE WHEN m >= 40 THEN 3 ELSE 2 END)",
              "least(10, greatest(0, floor(m / ((CASE WHEN m >= 40 THEN 3 ELSE 2 END) + 1)) - 1))")
    .replace("max_ts_", "last_ts"), LAB)

SCORED = PREDS + """,
tl AS (SELECT symbol, ts, CASE WHEN (lead(close, 10) OVER w - close) / close > 0.03 THEN 1
                               WHEN (lead(close, 10) OVER w - close) / close < -0.03 THEN 0 END AS target
       FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)),
sc AS (SELECT tl.symbol, tl.ts, tl.target, p.prediction, p.confidence,
              CASE WHEN p.prediction = 1 THEN p.confidence ELSE 1 - p.confidence END AS score
       FROM tl JOIN preds p USING (symbol, ts) WHERE tl.target IS NOT NULL)"""


def _metrics(src: str, by: str) -> str:
    return f"""
SELECT {by},
  CASE WHEN count(*) = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + fn + tn) END AS accuracy,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
  CAST(tp + fp + fn + tn AS BIGINT) AS n
FROM (SELECT {by},
        CAST(sum(CASE WHEN target = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
        CAST(sum(CASE WHEN target = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
        CAST(sum(CASE WHEN target = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
        CAST(sum(CASE WHEN target = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn
      FROM {src} GROUP BY {by}) c GROUP BY {by}, tp, fp, fn, tn"""


SQL["binary_metrics"] = rounded(with_bars(_metrics("sc", "symbol"), SCORED),
                                r6=["accuracy", "precision", "recall", "f1"])
SQL["roc_auc"] = rounded(with_bars("""
SELECT symbol, CASE WHEN P = 0 OR N = 0 THEN 0.5 ELSE (sr - P * (P + 1) / 2.0) / (P * N) END AS roc_auc
FROM (SELECT symbol, sum(CASE WHEN target = 1 THEN ar ELSE 0 END) AS sr,
             CAST(sum(target) AS DOUBLE) AS P, CAST(sum(1 - target) AS DOUBLE) AS N
      FROM (SELECT symbol, target,
                   (2 * rank() OVER (PARTITION BY symbol ORDER BY score)
                    + count(*) OVER (PARTITION BY symbol, score) - 1) / 2.0 AS ar
            FROM sc) r GROUP BY symbol) t""", SCORED), r6=["roc_auc"])
SQL["class_report"] = rounded(with_bars("""
SELECT c AS class,
  CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
  CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
  CAST(tp + fn AS BIGINT) AS support
FROM (SELECT c,
        CAST(sum(CASE WHEN target = c AND prediction = c THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
        CAST(sum(CASE WHEN target <> c AND prediction = c THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
        CAST(sum(CASE WHEN target = c AND prediction <> c THEN 1 ELSE 0 END) AS DOUBLE) AS fn
      FROM sc, (VALUES (0), (1)) v(c) GROUP BY c) t""", SCORED), r6=["precision", "recall", "f1"])
SQL["mean_confidence"] = rounded(with_bars(
    "SELECT symbol, avg(greatest(score, 1 - score)) AS mean_confidence FROM sc GROUP BY symbol", SCORED),
    r6=["mean_confidence"])

# ------------------------------------------------------------------ run ledger (rule model)

RULE_RUNS = """
wfa AS (
  SELECT symbol, ts, target, fold,
         CASE WHEN tpos >= m - (5 - fold) * floor(m / 6)
                   AND tpos < m - (5 - fold) * floor(m / 6) + floor(m / 6) THEN 'test'
              WHEN tpos < m - (5 - fold) * floor(m / 6) - 10 THEN 'train' END AS role
  FROM tr, range(0, 5) r(fold)
),
wt2 AS (
  SELECT w.symbol, w.ts, w.fold, w.target, p.prediction,
         CASE WHEN p.prediction = 1 THEN p.confidence ELSE 1 - p.confidence END AS score
  FROM wfa w JOIN preds p USING (symbol, ts) WHERE w.role = 'test'
),
fmet AS (""" + _metrics("wt2", "symbol, fold") + """),
fauc AS (
  SELECT symbol, fold, CASE WHEN P = 0 OR N = 0 THEN 0.5 ELSE (sr - P * (P + 1) / 2.0) / (P * N) END AS roc_auc,
         P = 0 OR N = 0 AS one_class
  FROM (SELECT symbol, fold, sum(CASE WHEN target = 1 THEN ar ELSE 0 END) AS sr,
               CAST(sum(target) AS DOUBLE) AS P, CAST(sum(1 - target) AS DOUBLE) AS N
        FROM (SELECT symbol, fold, target,
                     (2 * rank() OVER (PARTITION BY symbol, fold ORDER BY score)
                      + count(*) OVER (PARTITION BY symbol, fold, score) - 1) / 2.0 AS ar
              FROM wt2) r GROUP BY symbol, fold) t
),
ftr AS (SELECT symbol, fold, max(ts) AS last_ts FROM wfa WHERE role = 'train' GROUP BY symbol, fold),
runs0 AS (
  SELECT 'SmaRule' || m.symbol || 'Classifier' AS model_name, CAST(m.fold + 1 AS INTEGER) AS version,
         m.accuracy, m.f1, m.precision, m.recall, a.roc_auc,
         CASE WHEN m.fold = 0 THEN NULL ELSE 1 END AS n_features,
         epoch_ms(CAST(ftr.last_ts AS TIMESTAMP)) AS trained_ms
  FROM fmet m JOIN fauc a USING (symbol, fold) JOIN ftr USING (symbol, fold)
),
runs AS (SELECT *, '{"window": 20}' AS params,
                substr(sha256(model_name || ':' || version || ':' || trained_ms), 1, 16) AS run_id FROM runs0)"""

RUNS_WITH = f"WITH {FEAT}, {feature_sql(SIDE)}, {LAB}, " + PREDS + "," + RULE_RUNS
_RM = ["accuracy", "f1", "precision", "recall", "roc_auc"]

SQL["cv_summary"] = rounded(RUNS_WITH + """
SELECT m.symbol, avg(precision) AS precision, avg(recall) AS recall, avg(accuracy) AS accuracy,
       avg(CASE WHEN one_class THEN NULL ELSE roc_auc END) AS roc_auc
FROM fmet m JOIN fauc a USING (symbol, fold) GROUP BY m.symbol""", r6=["precision", "recall", "accuracy", "roc_auc"])

SQL["model_runs"] = rounded(RUNS_WITH + "\nSELECT * FROM runs", r6=_RM)
SQL["latest_model"] = rounded(RUNS_WITH + """
SELECT r.* FROM runs r JOIN (SELECT model_name, max(version) AS v FROM runs GROUP BY model_name) l
  ON l.model_name = r.model_name AND l.v = r.version""", r6=_RM)
# the ledger replayed run by run: each against the champion of its time
REPLAY = """
seq AS (SELECT *, row_number() OVER (PARTITION BY model_name ORDER BY version) AS k FROM runs),
dec AS (
  SELECT model_name, k, version, TRUE AS promoted, version AS cv, roc_auc AS cauc, n_features AS cn FROM seq WHERE k = 1
  UNION ALL
  SELECT model_name, k, version, won, CASE WHEN won THEN version ELSE cv END,
         CASE WHEN won THEN roc_auc ELSE cauc END, CASE WHEN won THEN n_features ELSE cn END
  FROM (SELECT s.*, d.cv, d.cauc, d.cn, d.cn IS NULL OR d.cn IS DISTINCT FROM s.n_features OR s.roc_auc > d.cauc AS won
        FROM dec d JOIN seq s ON s.model_name = d.model_name AND s.k = d.k + 1) t
),
fin AS (SELECT model_name, arg_max(cv, k) AS champion FROM dec GROUP BY model_name)"""
SQL["promotion_decision"] = rounded(RUNS_WITH + "," + REPLAY + """
SELECT r.model_name, r.version, r.accuracy, r.f1, r.roc_auc, r.n_features, r.params,
       CASE WHEN r.version = fin.champion THEN 'production' WHEN dec.promoted THEN 'archived' ELSE 'candidate' END AS status,
       dec.promoted
FROM runs r JOIN dec USING (model_name, version) JOIN fin USING (model_name)""", r6=["accuracy", "f1", "roc_auc"])
SQL["model_card"] = rounded(RUNS_WITH + """
SELECT r.model_name, regexp_replace(r.model_name, '(Classifier|Regressor)$', '') AS short_name,
       strftime(epoch_ms(r.trained_ms), '%Y-%m-%d') AS trained, r.version,
       r.accuracy, r.f1, r.precision, r.recall, r.roc_auc
FROM runs r JOIN (SELECT model_name, max(version) AS v FROM runs GROUP BY model_name) l
  ON l.model_name = r.model_name AND l.v = r.version""", r6=_RM)

# ------------------------------------------------------------------ scoring with the rule model

_IMP = f"""
imp AS (SELECT feature, round(abs(corr(value, t)), 9) AS importance FROM (
  UNPIVOT (SELECT {', '.join(PROFILE)}, CAST(target AS DOUBLE) AS t FROM feat)
  ON {', '.join(PROFILE)} INTO NAME feature VALUE value) u
  WHERE value IS NOT NULL AND t IS NOT NULL GROUP BY feature)"""
SQL["corr_top_features"] = rounded(with_feat(
    "SELECT feature, importance FROM imp ORDER BY importance DESC, feature LIMIT 15", _IMP), r6=["importance"])
SQL["corr_weakest_features"] = rounded(with_feat(
    "SELECT feature, importance FROM imp ORDER BY importance, feature LIMIT 15", _IMP), r6=["importance"])
SQL["corr_importance_drop"] = with_feat("SELECT feature FROM imp WHERE importance < 0.005", _IMP)
SQL["corr_kept_features"] = with_feat("""
SELECT feature FROM imp WHERE importance >= 0.005
  AND feature NOT IN (SELECT feature_b FROM cp)""", _IMP + "," + CORR_CTE)

RULE_SCORES = """
cwt AS (SELECT symbol, ts, target, tpos, m,
               weight * count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY target)) AS weight FROM wt),
rs AS (SELECT symbol, ts, prediction,
              round(CASE WHEN prediction = 1 THEN confidence ELSE 1 - confidence END, 3) AS raw FROM preds),
rtest AS (SELECT s.symbol, s.ts, CAST(s.target AS DOUBLE) AS label, rs.raw, rs.prediction
          FROM spl s JOIN rs USING (symbol, ts) WHERE s.split = 'test')"""
SCORE_WITH = RUNS_WITH + "," + RULE_SCORES

SQL["rule_score_rows"] = rounded(SCORE_WITH + """
SELECT symbol, ts, CAST(raw >= 0.5 AS INTEGER) AS prediction, greatest(raw, 1 - raw) AS confidence FROM rtest""",
                            r6=["confidence"])

# isotonic fit by its min-max formula over the distinct scores of a fold:
# iso(i) = max over a <= i of min over b >= i of the weighted mean of a..b;
# between two scores the fit is a straight line, outside it is constant
SQL["rule_calibrated_scores"] = rounded(SCORE_WITH + """,
cf AS (SELECT fold, rs.raw, sum(c.target * c.weight) AS wy, sum(c.weight) AS w
       FROM (SELECT *, CASE WHEN m >= 40 THEN 3 ELSE 2 END AS kk FROM cwt) c JOIN rs USING (symbol, ts), range(0, 3) r(fold)
       WHERE fold < kk AND tpos >= m - (kk - fold) * floor(m / (kk + 1))
             AND tpos < m - (kk - fold) * floor(m / (kk + 1)) + floor(m / (kk + 1))
       GROUP BY fold, rs.raw),
pt AS (SELECT *, row_number() OVER f AS i, sum(wy) OVER f AS cy, sum(w) OVER f AS cw
       FROM cf WINDOW f AS (PARTITION BY fold ORDER BY raw)),
ab AS (SELECT a.fold, a.i AS a, b.i AS b, (b.cy - a.cy + a.wy) / (b.cw - a.cw + a.w) AS mean
       FROM pt a JOIN pt b ON a.fold = b.fold AND a.i <= b.i),
lo AS (SELECT fold, a, b AS i, min(mean) OVER (PARTITION BY fold, a ORDER BY b DESC ROWS UNBOUNDED PRECEDING) AS v FROM ab),
iso AS (SELECT pt.fold, pt.raw, max(lo.v) AS v FROM lo JOIN pt ON pt.fold = lo.fold AND pt.i = lo.i GROUP BY pt.fold, pt.raw),
q AS (SELECT f.fold, t.raw FROM (SELECT DISTINCT raw FROM rtest) t, (SELECT DISTINCT fold FROM iso) f),
fit AS (SELECT q.fold, q.raw, l.raw AS x0, l.v AS y0, u.raw AS x1, u.v AS y1
        FROM q ASOF LEFT JOIN iso l ON l.fold = q.fold AND q.raw >= l.raw
        ASOF LEFT JOIN iso u ON u.fold = q.fold AND q.raw <= u.raw),
pr AS (SELECT raw, avg(CASE WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL OR x0 = x1 THEN y0
                            ELSE y0 + (y1 - y0) * (raw - x0) / (x1 - x0) END) AS prob_up FROM fit GROUP BY raw)
SELECT t.symbol, t.ts, t.label, pr.prob_up, 'isotonic' AS method FROM rtest t JOIN pr USING (raw)""", r6=["prob_up"])

SQL["rule_predict_latest"] = rounded(RUNS_WITH + "," + REPLAY + """,
prod AS (SELECT regexp_extract(model_name, '^SmaRule(.*)Classifier$', 1) AS symbol, champion FROM fin)
SELECT p.symbol, p.ts, p.prediction, p.confidence, p.horizon_days, bars.close AS entry_price,
       CAST(prod.champion AS INTEGER) AS model_version
FROM preds p JOIN (SELECT symbol, max(ts) AS ts FROM feat GROUP BY symbol) n USING (symbol, ts)
JOIN prod USING (symbol) LEFT JOIN bars USING (symbol, ts)""", r6=["confidence"])

# ------------------------------------------------------------------ fitted models: keys and facts

_TEST = "FROM spl WHERE split = 'test'"
_FIT = "SELECT symbol, ts, CAST(target AS DOUBLE) AS label, {} AS n_trees, TRUE AS in_range, TRUE AS better_than_chance "
SQL["fit_forest"] = with_feat(_FIT.format(300) + _TEST, LAB)
SQL["fit_gbt"] = with_feat(_FIT.format(500) + _TEST, LAB)
SQL["calibrated_scores"] = with_feat(
    "SELECT symbol, ts, CAST(target AS DOUBLE) AS label, 'isotonic' AS method, "
    "(SELECT CASE WHEN max(m) >= 40 THEN 3 ELSE 2 END FROM tr) AS n_folds, TRUE AS in_range " + _TEST, LAB)
SQL["score_rows"] = with_feat(
    "SELECT symbol, ts, CAST(target AS DOUBLE) AS label, TRUE AS consistent " + _TEST, LAB)
SQL["feature_importances"] = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, TRUE AS in_range, TRUE AS sums_to_one" for c in PROFILE)
SQL["random_search"] = RUNS_WITH + f"""
SELECT CAST(t AS INTEGER) AS trial, CAST(n AS INTEGER) AS n_folds, TRUE AS in_range FROM range(0, {SEARCH_TRIALS}) r(t),
  (SELECT count(*) AS n FROM (SELECT fold FROM wfa WHERE role IS NOT NULL GROUP BY fold
   HAVING count(DISTINCT CASE WHEN role = 'train' THEN target END) = 2
      AND count(DISTINCT CASE WHEN role = 'test' THEN target END) = 2) f) g"""
SQL["predict_latest"] = RUNS_WITH + """
SELECT n.symbol, n.ts, 10 AS horizon_days, bars.close AS entry_price, TRUE AS scored, TRUE AS consistent
FROM (SELECT symbol, max(ts) AS ts FROM feat GROUP BY symbol) n LEFT JOIN bars USING (symbol, ts)"""


def _tree_sql() -> str:
    """The first two levels of tree 0: the draws are hashes of node and feature
    alone, so they are literals here; ranges, sides and gains come from the rows."""
    import numpy as np

    m = int(len(PROFILE) ** 0.5)
    ids, draws = {"": T.root_id(42, 0)}, []
    for path in ("", "L", "R"):
        for side, name in enumerate("LR"):
            ids[path + name] = T.child_id(ids[path], side)
        node = np.array([ids[path]])
        order = np.argsort(T._draws(node, len(PROFILE), 1)[0], kind="stable").tolist()
        u = (T._draws(node, len(PROFILE), 2)[0] >> np.uint64(11)).astype(float) / float(1 << 53)
        draws += [f"('{path}', '{PROFILE[f]}', {i}, {float(u[f])!r}::DOUBLE)" for i, f in enumerate(order)]
    gini = "(CASE WHEN {0} > 0 THEN 2 * {1} * ({0} - {1}) / {0} ELSE 0 END)"
    own, left = gini.format("w", "w1"), gini.format("lw", "lw1")
    right = gini.format("(w - lw)", "(w1 - lw1)")

    def level(k: int) -> str:
        rows = "x0" if k == 0 else f"x{k}"
        return f"""
n{k} AS (SELECT path, count(*) AS n, sum(cw) AS w, sum(cw * target) AS w1 FROM {rows} GROUP BY path),
l{k} AS (SELECT rid, path, target, cw, feature, value FROM (
  UNPIVOT (SELECT rid, path, target, cw, {', '.join(PROFILE)} FROM {rows})
  ON {', '.join(PROFILE)} INTO NAME feature VALUE value) u),
c{k} AS (SELECT path, feature, rank, CASE WHEN lo + u * (hi - lo) >= hi THEN lo ELSE lo + u * (hi - lo) END AS t
  FROM (SELECT path, feature, min(value) AS lo, max(value) AS hi FROM l{k} GROUP BY path, feature) r
  JOIN draws USING (path, feature) WHERE lo < hi QUALIFY row_number() OVER (PARTITION BY path ORDER BY rank) <= {m}),
s{k} AS (SELECT c.path, c.feature, c.rank, c.t, any_value(n.n) AS n, any_value(n.w) AS w, any_value(n.w1) AS w1,
    count_if(l.value <= c.t) AS ln, sum(CASE WHEN l.value <= c.t THEN l.cw ELSE 0 END) AS lw,
    sum(CASE WHEN l.value <= c.t THEN l.cw * l.target ELSE 0 END) AS lw1
  FROM c{k} c JOIN l{k} l USING (path, feature) JOIN n{k} n USING (path) GROUP BY c.path, c.feature, c.rank, c.t),
g{k} AS (SELECT *, {own} - {left} - {right} AS gain FROM s{k} WHERE ln >= 1 AND n - ln >= 1 AND w1 > 0 AND w1 < w),
b{k} AS (SELECT * FROM (SELECT *, max(gain) OVER (PARTITION BY path) - {T.TIE} * w AS least FROM g{k}) z
  WHERE gain >= least QUALIFY row_number() OVER (PARTITION BY path ORDER BY rank) = 1),
x{k + 1} AS (SELECT x.* REPLACE (x.path || CASE WHEN l.value <= b.t THEN 'L' ELSE 'R' END AS path)
  FROM {rows} x JOIN b{k} b USING (path) JOIN l{k} l ON l.rid = x.rid AND l.feature = b.feature)"""

    return f"""
draws(path, feature, rank, u) AS (VALUES {', '.join(draws)}),
x0 AS (SELECT *, row_number() OVER () AS rid, '' AS path,
              weight * count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY target)) AS cw FROM wt),""" \
        + level(0) + "," + level(1) + """,
n2 AS (SELECT path, count(*) AS n, sum(cw) AS w, sum(cw * target) AS w1 FROM x2 GROUP BY path)"""


SQL["extra_tree_depth2"] = rounded(with_feat("""
SELECT n.path, b.feature, b.t AS threshold, n.w1 / n.w AS value, n.n
FROM (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2) n
LEFT JOIN (SELECT path, feature, t FROM b0 UNION ALL SELECT path, feature, t FROM b1) b USING (path)""",
                                             LAB + "," + _tree_sql()), r6=["threshold", "value"])

# ------------------------------------------------------------------ streaming

SQL["stream_bars"] = SQL["ohlcv_bars_hourly"]
# hours that the watermark (newest event less one hour) has passed
SQL["final_bars"] = SQL["ohlcv_bars_hourly"] + """
WHERE ts + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events)"""

# ------------------------------------------------------------------ manifest diff (schema and rows of two queries)

SQL["manifest_diff"] = f"""
WITH e AS (SELECT column_name AS col FROM (DESCRIBE {SQL["feature_table"]})),
     a AS (SELECT column_name AS col FROM (DESCRIBE {SQL["stationary"]}))
SELECT col AS "column", (SELECT count(*) FROM ({SQL["feature_table"]}) f) AS row_count, 'missing' AS status
FROM (SELECT col FROM e EXCEPT SELECT col FROM a) m
UNION ALL
SELECT col AS "column", (SELECT count(*) FROM ({SQL["stationary"]}) s) AS row_count, 'extra' AS status
FROM (SELECT col FROM a EXCEPT SELECT col FROM e) x"""

# ------------------------------------------------------------------ documented extras

_WSUM = " + ".join(f"lag(close, {j}) OVER w * {10 - j}.0" for j in range(10))
SQL["legacy_indicators"] = rounded(f"WITH {REC}," + f"""
lx AS (
  SELECT b.*,
         CASE WHEN count(close) OVER f10 = 10 THEN avg(close) OVER f10 END AS sma_10,
         CASE WHEN count(close) OVER f10 = 10 THEN ({_WSUM}) / 55.0 END AS wma_10,
         close - lag(close, 10) OVER w AS momentum_10,
         CASE WHEN count(close) OVER f14 = 14 THEN
              {ratio('max(high) OVER f14 - close', 'max(high) OVER f14 - min(low) OVER f14')} * -100 END AS williams_r,
         {ratio('close - low', 'high - low')} * 100 AS k_intraday,
         coalesce(CASE WHEN high = low THEN 0.0 ELSE ((close - low) - (high - close)) / (high - low) END, 0.0) * volume AS mfv,
         CASE WHEN count(close) OVER f20 = 20 THEN avg(close) OVER f20 END AS bb_mid,
         CASE WHEN count(close) OVER f20 = 20 THEN avg(close) OVER f20 + 2.0 * stddev_pop(close) OVER f20 END AS bb_up,
         CASE WHEN count(close) OVER f20 = 20 THEN avg(close) OVER f20 - 2.0 * stddev_pop(close) OVER f20 END AS bb_low
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_no),
       f10 AS (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
       f14 AS (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
       f20 AS (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
)
SELECT lx.symbol, lx.ts, sma_10, wma_10, momentum_10, williams_r, k_intraday,
       CASE WHEN count(k_intraday) OVER f3 = 3 THEN avg(k_intraday) OVER f3 END AS d_intraday,
       recind.macd - recind.macd_signal AS macd_hist,
       sum(mfv) OVER (PARTITION BY lx.symbol ORDER BY lx.bar_no ROWS UNBOUNDED PRECEDING) AS adi,
       bb_up, bb_mid, bb_low
FROM lx JOIN recind USING (symbol, bar_no)
WINDOW f3 AS (PARTITION BY lx.symbol ORDER BY lx.bar_no ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    r6=["sma_10", "wma_10", "d_intraday", "bb_up", "bb_mid", "bb_low", "adi"], r4=["macd_hist"])

SQL["fair_value_gaps"] = with_bars(f"""
SELECT symbol, ts, 'bullish' AS direction, h1 AS gap_low, ln AS gap_high FROM fv WHERE h1 < ln
UNION ALL
SELECT symbol, ts, 'bearish' AS direction, hn AS gap_low, l1 AS gap_high FROM fv WHERE l1 > hn""", f"""
fv AS (SELECT symbol, ts, lag(high) OVER w AS h1, lag(low) OVER w AS l1,
              lead(high) OVER w AS hn, lead(low) OVER w AS ln FROM b {W})""")

_LIFE = """
SELECT z.symbol, z.ts, z.direction, z.zone_low, z.zone_high,
  (SELECT min(x.ts) FROM b x WHERE x.symbol = z.symbol AND x.bar_no > z.known
     AND CASE WHEN z.direction = 'bullish' THEN x.low <= z.zone_high ELSE x.high >= z.zone_low END) AS first_touch,
  (SELECT min(x.ts) FROM b x WHERE x.symbol = z.symbol AND x.bar_no > z.known
     AND CASE WHEN z.direction = 'bullish' THEN x.low <= z.zone_low ELSE x.high >= z.zone_high END) AS filled
FROM z"""
SQL["gap_lifetimes"] = with_bars(_LIFE, f"""
fv AS (SELECT symbol, ts, bar_no + 1 AS known, lag(high) OVER w AS h1, lag(low) OVER w AS l1,
              lead(high) OVER w AS hn, lead(low) OVER w AS ln FROM b {W}),
z AS (SELECT symbol, ts, known, 'bullish' AS direction, h1 AS zone_low, ln AS zone_high FROM fv WHERE h1 < ln
      UNION ALL SELECT symbol, ts, known, 'bearish', hn, l1 FROM fv WHERE l1 > hn)""")
SQL["order_blocks"] = with_bars(_LIFE, swings_sql("b", 5) + """,
z AS (SELECT symbol, ts, bar_no + 5 AS known, CASE WHEN r.swing_type = 'low' THEN 'bullish' ELSE 'bearish' END AS direction,
             CASE WHEN r.swing_type = 'low' THEN low ELSE least(open, close) END AS zone_low,
             CASE WHEN r.swing_type = 'low' THEN greatest(open, close) ELSE high END AS zone_high
      FROM raw r JOIN b USING (symbol, ts))""")


def _timeframe_sql() -> str:
    parts, events = [], []
    for f in TF.TIMEFRAMES:
        p = f"t{f.name}_"
        parts.append(f"""
{p}b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM (
  SELECT event_type AS symbol, time_bucket(INTERVAL '{f.width}', ts) AS ts, first(value ORDER BY ts, event_id) AS open,
         max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close
  FROM events GROUP BY 1, 2) q),""" + swings_sql(f"{p}b", f.order, p) + f""",
{p}k AS (SELECT s.symbol, e.ts + INTERVAL '{f.width}' AS known, arg_max(s.trend, s.k) AS trend
  FROM {p}sw s JOIN {p}b c USING (symbol, ts) JOIN {p}b e ON e.symbol = c.symbol AND e.bar_no = c.bar_no + {f.order}
  GROUP BY 1, 2)""")
        events.append(f"ASOF LEFT JOIN {p}k k_{f.name} ON k_{f.name}.symbol = s.symbol "
                      f"AND s.ts + INTERVAL '{TF.TIMEFRAMES[0].width}' >= k_{f.name}.known")
    names = [f.name for f in TF.TIMEFRAMES]
    cols = ", ".join(f"coalesce(k_{n}.trend, 'neutral') AS trend_{n}" for n in names)
    same = " AND ".join(f"trend_{n} = trend_{names[-1]}" for n in names[:-1])
    return f"""WITH {','.join(parts)}
SELECT *, CASE WHEN trend_{names[-1]} = 'neutral' THEN 'neutral'
               ELSE CASE WHEN trend_{names[-1]} = 'up' THEN 'bullish' ELSE 'bearish' END
                    || CASE WHEN {same} THEN '' ELSE '_wait' END END AS status
FROM (SELECT s.symbol, s.ts, {cols} FROM t{names[0]}_b s {' '.join(events)}) x"""


SQL["timeframe_status"] = _timeframe_sql()

SF_CTE = SW + "," + SIGNALS + f""",
chs AS (SELECT s.symbol, s.swing_ts, coalesce(brk.bts, s.swing_ts) AS bts
        FROM sig2 s LEFT JOIN brk USING (symbol, k) WHERE s.type = 'choch'),
hi AS (SELECT r.symbol, bb.bar_no + 5 AS kb, r.price FROM raw r JOIN b bb USING (symbol, ts) WHERE r.swing_type = 'high'),
lo AS (SELECT r.symbol, bb.bar_no + 5 AS kb, r.price FROM raw r JOIN b bb USING (symbol, ts) WHERE r.swing_type = 'low'),
lab AS (SELECT symbol, kb, arg_max(struct_pack(trend := trend, seq_count := seq_count, seq_dir := seq_dir), k) AS lab
        FROM (SELECT sw.*, bb.bar_no + 5 AS kb FROM sw JOIN b bb USING (symbol, ts)) t GROUP BY symbol, kb),
ch AS (SELECT c.symbol, bb.bar_no + 5 AS kb, max(c.bts) AS bts
       FROM chs c JOIN b bb ON bb.symbol = c.symbol AND bb.ts = c.swing_ts GROUP BY 1, 2),
ev AS (
  SELECT b.symbol, b.ts, b.bar_no, b.close, hi.price AS hi_at, lo.price AS lo_at, lab.lab, ch.bts AS choch_at
  FROM b LEFT JOIN hi ON hi.symbol = b.symbol AND hi.kb = b.bar_no
         LEFT JOIN lo ON lo.symbol = b.symbol AND lo.kb = b.bar_no
         LEFT JOIN lab ON lab.symbol = b.symbol AND lab.kb = b.bar_no
         LEFT JOIN ch ON ch.symbol = b.symbol AND ch.kb = b.bar_no
),
cf AS (
  SELECT symbol, ts, close,
         last_value(hi_at IGNORE NULLS) OVER w AS hi_at, last_value(lo_at IGNORE NULLS) OVER w AS lo_at,
         last_value(lab IGNORE NULLS) OVER w AS lab, last_value(choch_at IGNORE NULLS) OVER w AS choch_at
  FROM ev WINDOW w AS (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING)
)"""

SQL["structure_features"] = rounded(with_bars(f"""
SELECT symbol, ts, coalesce(lab.trend, 'neutral') AS structure_trend,
       {ratio('close - hi_at', 'hi_at')} * 100 AS swing_distance_high,
       {ratio('close - lo_at', 'lo_at')} * 100 AS swing_distance_low,
       CASE WHEN lab.seq_dir = 'long' THEN lab.seq_count ELSE 0 END AS consecutive_bullish,
       CASE WHEN lab.seq_dir = 'short' THEN lab.seq_count ELSE 0 END AS consecutive_bearish,
       CAST(ts - choch_at AS INTEGER) AS days_since_choch
FROM cf""", SF_CTE), r6=["swing_distance_high", "swing_distance_low"])

SQL["interaction_features"] = rounded(with_feat(f"""
SELECT symbol, ts, rsi * volume AS rsi_x_volume, {ratio('close', 'AO_close')} AS return_ratio,
       {ratio('atr_norm', 'vol_roll20')} AS atr_vol_ratio
FROM feat"""), r6=["rsi_x_volume", "return_ratio", "atr_vol_ratio"])
