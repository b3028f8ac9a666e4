"""SQL text shared by the DuckDB oracle statements (value checks).

The oracle restates every query in plain window SQL over the driver's tables,
with a positional ``row_number`` and recursive CTEs for recurrences -- i.e. an
independent, sequential formulation of what the Spark plans compute in
parallel.
"""

from __future__ import annotations

DAILY_BARS = """
bars AS (
  SELECT l_returnflag || l_linestatus AS symbol,
         CAST(l_shipdate AS DATE) AS ts,
         first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open,
         max(l_extendedprice / l_quantity) AS high,
         min(l_extendedprice / l_quantity) AS low,
         last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close,
         sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2
),
b AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_no FROM bars
)"""

HOURLY_BARS = """
hbars AS (
  SELECT event_type AS symbol,
         date_trunc('hour', ts) AS ts,
         first(value ORDER BY ts, event_id) AS open,
         max(value) AS high,
         min(value) AS low,
         last(value ORDER BY ts, event_id) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2
)"""


def ratio(n: str, d: str) -> str:
    """SQL form of :func:`candleflow.functions.scalar.ratio`."""
    return (f"(CASE WHEN ({n}) IS NULL OR ({d}) IS NULL THEN NULL "
            f"WHEN ({d}) = 0 AND ({n}) = 0 THEN NULL WHEN ({d}) = 0 THEN 0.0 "
            f"ELSE ({n}) / ({d}) END)")


def pct_change(x: str, prev: str) -> str:
    return (f"(CASE WHEN ({prev}) IS NULL OR ({x}) IS NULL THEN NULL "
            f"WHEN ({prev}) = 0 THEN (CASE WHEN ({x}) = 0 THEN NULL ELSE 0.0 END) "
            f"ELSE ({x}) / ({prev}) - 1 END)")


def rounded(select_sql: str, r6=(), r4=(), r3=(), r2=()) -> str:
    """Wrap a query so listed columns are rounded like the Spark output."""
    parts = [f"round({c}, 6) AS {c}" for c in r6] + [f"round({c}, 4) AS {c}" for c in r4] + \
        [f"round({c}, 3) AS {c}" for c in r3] + [f"round({c}, 2) AS {c}" for c in r2]
    if not parts:
        return select_sql
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({select_sql}) AS _r"


# Inputs of the recursive indicators: lags, true range, directional moves.
REC_INPUTS = """
lg AS (
  SELECT b.*, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)
),
x AS (
  SELECT symbol, ts, bar_no, open, high, low, close, volume,
         CASE WHEN pc IS NULL THEN high - low
              ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr,
         CASE WHEN pc IS NULL THEN 0.0 WHEN close - pc > 0 THEN close - pc ELSE 0.0 END AS gain,
         CASE WHEN pc IS NULL THEN 0.0 WHEN pc - close > 0 THEN pc - close ELSE 0.0 END AS loss,
         CASE WHEN ph IS NOT NULL AND (high - ph) > (pl - low) AND (high - ph) > 0
              THEN high - ph ELSE 0.0 END AS pdm,
         CASE WHEN ph IS NOT NULL AND (pl - low) > (high - ph) AND (pl - low) > 0
              THEN pl - low ELSE 0.0 END AS mdm
  FROM lg
),
xs AS (
  SELECT x.*,
         avg(tr) OVER w14 AS tr_mean14, sum(tr) OVER w14 AS tr_sum14,
         sum(pdm) OVER w14 AS pdm_sum14, sum(mdm) OVER w14 AS mdm_sum14
  FROM x WINDOW w14 AS (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)
),
rec AS (
  SELECT symbol, bar_no, close AS e10, close AS e20, close AS e12, close AS e26,
         gain AS au, loss AS ad, CAST(0 AS DOUBLE) AS atr, CAST(0 AS DOUBLE) AS trs,
         CAST(0 AS DOUBLE) AS pdms, CAST(0 AS DOUBLE) AS mdms
  FROM xs WHERE bar_no = 0
  UNION ALL
  SELECT s.symbol, s.bar_no,
         (1 - 2.0/11) * r.e10 + (2.0/11) * s.close,
         (1 - 2.0/21) * r.e20 + (2.0/21) * s.close,
         (1 - 2.0/13) * r.e12 + (2.0/13) * s.close,
         (1 - 2.0/27) * r.e26 + (2.0/27) * s.close,
         (13.0 * r.au + s.gain) / 14.0,
         (13.0 * r.ad + s.loss) / 14.0,
         CASE WHEN s.bar_no = 13 THEN s.tr_mean14
              WHEN s.bar_no > 13 THEN (13.0 * r.atr + s.tr) / 14.0 ELSE 0.0 END,
         CASE WHEN s.bar_no = 14 THEN s.tr_sum14
              WHEN s.bar_no > 14 THEN r.trs - r.trs / 14.0 + s.tr ELSE 0.0 END,
         CASE WHEN s.bar_no = 14 THEN s.pdm_sum14
              WHEN s.bar_no > 14 THEN r.pdms - r.pdms / 14.0 + s.pdm ELSE 0.0 END,
         CASE WHEN s.bar_no = 14 THEN s.mdm_sum14
              WHEN s.bar_no > 14 THEN r.mdms - r.mdms / 14.0 + s.mdm ELSE 0.0 END
  FROM rec r JOIN xs s ON s.symbol = r.symbol AND s.bar_no = r.bar_no + 1
),
ind AS (
  SELECT xs.symbol, xs.ts, xs.bar_no, xs.close,
         CASE WHEN xs.bar_no >= 9 THEN e10 END AS ema_10,
         CASE WHEN xs.bar_no >= 19 THEN e20 END AS ema_20,
         CASE WHEN xs.bar_no >= 25 THEN e12 - e26 END AS macd,
         CASE WHEN xs.bar_no >= 13 THEN (CASE WHEN ad = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + au / ad) END) END AS rsi,
         CASE WHEN xs.bar_no >= 13 THEN atr END AS atr,
         CASE WHEN xs.bar_no >= 14 THEN (CASE WHEN trs = 0 THEN 0.0 ELSE 100.0 * pdms / trs END) END AS pdi,
         CASE WHEN xs.bar_no >= 14 THEN (CASE WHEN trs = 0 THEN 0.0 ELSE 100.0 * mdms / trs END) END AS mdi
  FROM xs JOIN rec USING (symbol, bar_no)
),
ind2 AS (
  SELECT ind.*,
         CASE WHEN bar_no >= 14 THEN (CASE WHEN pdi + mdi = 0 THEN 0.0
              ELSE 100.0 * abs(pdi - mdi) / (pdi + mdi) END) END AS dx
  FROM ind
),
ind3 AS (
  SELECT ind2.*, avg(dx) OVER (PARTITION BY symbol ORDER BY bar_no
                               ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS dx_mean14
  FROM ind2
),
rec2 AS (
  SELECT symbol, bar_no, CAST(0 AS DOUBLE) AS sig, CAST(0 AS DOUBLE) AS adx FROM ind3 WHERE bar_no = 0
  UNION ALL
  SELECT s.symbol, s.bar_no,
         CASE WHEN s.bar_no = 25 THEN s.macd
              WHEN s.bar_no > 25 THEN (1 - 2.0/10) * r.sig + (2.0/10) * s.macd ELSE 0.0 END,
         CASE WHEN s.bar_no = 27 THEN s.dx_mean14
              WHEN s.bar_no > 27 THEN (13.0 * r.adx + s.dx) / 14.0 ELSE 0.0 END
  FROM rec2 r JOIN ind3 s ON s.symbol = r.symbol AND s.bar_no = r.bar_no + 1
),
recind AS (
  SELECT i.symbol, i.ts, i.bar_no, i.close, i.ema_10, i.ema_20, i.macd,
         CASE WHEN i.bar_no >= 33 THEN r.sig END AS macd_signal,
         i.rsi, i.atr,
         """ + ratio("i.atr", "i.close") + """ AS atr_norm,
         CASE WHEN i.bar_no >= 15 THEN i.pdi END AS dmi_pos,
         CASE WHEN i.bar_no >= 15 THEN i.mdi END AS dmi_neg,
         CASE WHEN i.bar_no >= 27 THEN r.adx END AS adx
  FROM ind3 i JOIN rec2 r USING (symbol, bar_no)
)"""


# Parabolic SAR as a recursive CTE over (trend, extreme points, af, sar).
PSAR = """
pl2 AS (
  SELECT symbol, ts, bar_no, high, low, close,
         lag(high, 1) OVER w AS h1, lag(high, 2) OVER w AS h2,
         lag(low, 1) OVER w AS l1, lag(low, 2) OVER w AS l2,
         first_value(high) OVER w AS h0, first_value(low) OVER w AS lo0
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)
),
ps AS (
  SELECT symbol, bar_no, close AS sar, TRUE AS up, h0 AS ep_hi, lo0 AS ep_lo, CAST(0.02 AS DOUBLE) AS af
  FROM pl2 WHERE bar_no = 1
  UNION ALL
  SELECT symbol, bar_no,
         CASE WHEN up THEN (CASE WHEN rev THEN ep_hi0 ELSE
                 (CASE WHEN l2 < s THEN l2 WHEN l1 < s THEN l1 ELSE s END) END)
              ELSE (CASE WHEN rev THEN ep_lo0 ELSE
                 (CASE WHEN h2 > s THEN h2 WHEN h1 > s THEN h1 ELSE s END) END) END,
         CASE WHEN rev THEN NOT up ELSE up END,
         CASE WHEN up THEN (CASE WHEN NOT rev AND high > ep_hi0 THEN high ELSE ep_hi0 END)
              ELSE (CASE WHEN rev THEN high ELSE ep_hi0 END) END,
         CASE WHEN up THEN (CASE WHEN rev THEN low ELSE ep_lo0 END)
              ELSE (CASE WHEN NOT rev AND low < ep_lo0 THEN low ELSE ep_lo0 END) END,
         CASE WHEN rev THEN CAST(0.02 AS DOUBLE)
              WHEN up AND high > ep_hi0 THEN least(af0 + CAST(0.02 AS DOUBLE), CAST(0.2 AS DOUBLE))
              WHEN NOT up AND low < ep_lo0 THEN least(af0 + CAST(0.02 AS DOUBLE), CAST(0.2 AS DOUBLE))
              ELSE af0 END
  FROM (
    SELECT p.symbol, p.bar_no, p.high, p.low, p.h1, p.h2, p.l1, p.l2,
           r.up, r.ep_hi AS ep_hi0, r.ep_lo AS ep_lo0, r.af AS af0,
           CASE WHEN r.up THEN r.sar + r.af * (r.ep_hi - r.sar)
                ELSE r.sar - r.af * (r.sar - r.ep_lo) END AS s,
           CASE WHEN r.up THEN p.low < r.sar + r.af * (r.ep_hi - r.sar)
                ELSE p.high > r.sar - r.af * (r.sar - r.ep_lo) END AS rev
    FROM ps r JOIN pl2 p ON p.symbol = r.symbol AND p.bar_no = r.bar_no + 1
  ) AS st
),
psar AS (
  SELECT b.symbol, b.ts, b.bar_no,
         CASE WHEN b.bar_no <= 1 THEN b.close ELSE ps.sar END AS psar
  FROM b LEFT JOIN ps USING (symbol, bar_no)
)"""


def _frame(k: int) -> str:
    return f"(PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def _full(col: str, k: int, expr: str) -> str:
    return f"CASE WHEN count({col}) OVER {_frame(k)} = {k} THEN {expr} END"


# Every bounded-window indicator plus OBV and the label, from ``b``.
BOUNDED = """
r0 AS (
  SELECT b.*, lag(close) OVER w AS pc, lag(close, 10) OVER w AS pc10, lead(close, 10) OVER w AS fc
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)
),
r1 AS (
  SELECT r0.*, """ + pct_change("close", "pc") + """ AS ret,
         (high + low + close) / 3.0 AS tp,
         (CASE WHEN high = low THEN 0.0
               ELSE ((close - low) - (high - close)) / (high - low) END) * volume AS mfv,
         CASE WHEN close < pc THEN -volume ELSE volume END AS obv_flow
  FROM r0
),
bnd AS (
  SELECT symbol, ts, bar_no, close, volume, tp,
         """ + ", ".join(f"lag(ret, {k}) OVER w AS ret_lag{k}" for k in (1, 2, 3, 5, 10, 20)) + """,
         """ + ", ".join(_full("ret", k, f"stddev_samp(ret) OVER {_frame(k)}") + f" AS vol_roll{k}"
                         for k in (5, 10, 20, 60)) + """,
         """ + ratio("open - pc", "pc") + """ AS gap_ret,
         """ + ratio("high - low", "close") + """ AS intraday_range,
         """ + ratio("close - pc10", "pc10") + """ * 100 AS roc,
         """ + _full("close", 14, ratio(f"close - min(low) OVER {_frame(14)}",
                                        f"max(high) OVER {_frame(14)} - min(low) OVER {_frame(14)}") + " * 100") + """ AS stoch_k,
         """ + _full("volume", 10, f"sum(mfv) OVER {_frame(10)} / sum(volume) OVER {_frame(10)}") + """ AS adosc,
         count(close) OVER """ + _frame(20) + """ AS bb_n,
         avg(close) OVER """ + _frame(20) + """ AS bb_mid,
         stddev_pop(close) OVER """ + _frame(20) + """ AS bb_sd,
         list(tp) OVER """ + _frame(14) + """ AS tpw,
         sum(obv_flow) OVER (PARTITION BY symbol ORDER BY bar_no ROWS UNBOUNDED PRECEDING) AS obv,
         CAST(CASE WHEN (fc - close) / close > 0.03 THEN 1
                   WHEN (fc - close) / close < -0.03 THEN 0 END AS INTEGER) AS target
  FROM r1 WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)
),
bnd2 AS (
  SELECT * EXCLUDE (tp, tpw, tpm, bb_n, bb_mid, bb_sd, bb_hi, bb_lo),
         CASE WHEN bb_n = 20 THEN """ + ratio("close - bb_lo", "bb_hi - bb_lo") + """ END AS bb_pband,
         CASE WHEN bb_n = 20 THEN """ + ratio("bb_hi - bb_lo", "bb_mid") + """ * 100 END AS bb_width,
         CASE WHEN len(tpw) = 14 THEN """ + ratio(
    "tp - tpm", "list_sum(list_transform(tpw, lambda v: abs(v - tpm))) / len(tpw) * 0.015") + """ END AS cci
  FROM (SELECT *, list_sum(tpw) / len(tpw) AS tpm,
               bb_mid + 2.0 * bb_sd AS bb_hi, bb_mid - 2.0 * bb_sd AS bb_lo FROM bnd) t
),
allind AS (
  SELECT bnd2.*, recind.ema_10, recind.ema_20, recind.macd, recind.macd_signal, recind.rsi,
         recind.atr_norm, recind.dmi_pos, recind.dmi_neg, recind.adx, psar.psar
  FROM bnd2 JOIN recind USING (symbol, bar_no) JOIN psar USING (symbol, bar_no)
)"""

INDICATOR_COLS = ["ema_10", "ema_20", "psar", "rsi", "roc", "obv", "macd", "macd_signal", "cci",
                  "adosc", "stoch_k", "dmi_pos", "dmi_neg", "adx", "bb_pband", "bb_width",
                  "atr_norm", "ret_lag1", "ret_lag2", "ret_lag3", "ret_lag5", "ret_lag10",
                  "ret_lag20", "vol_roll5", "vol_roll10", "vol_roll20", "vol_roll60", "gap_ret",
                  "intraday_range"]

SURVIVING = """
surv AS (
  SELECT symbol, ts, close, volume, target, """ + ", ".join(INDICATOR_COLS) + """,
         row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS sbar
  FROM allind WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in INDICATOR_COLS) + """
)"""


def side_panel_sql(side: list[str]) -> str:
    cols = ", ".join(f"max(CASE WHEN symbol = '{s}' THEN close END) AS {s}_close" for s in side)
    lst = ", ".join(f"'{s}'" for s in side)
    return f"""
panel AS (SELECT ts, {cols} FROM bars WHERE symbol IN ({lst}) GROUP BY ts)"""


def cubic_sql(src: str) -> str:
    """CTE chain from ``src(symbol, ts, close)`` to ``cubic(symbol, ts, close)``:
    the not-a-knot spline of every series, by elimination knot after knot."""
    return f"""
kn AS (SELECT symbol, ts, CAST(epoch(CAST(ts AS TIMESTAMP)) AS DOUBLE) AS x, close AS y,
              row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n
       FROM {src} WHERE close IS NOT NULL),
hh AS (SELECT *, x - lag(x) OVER w AS h0, lead(x) OVER w - x AS h1, (y - lag(y) OVER w) / (x - lag(x) OVER w) AS s0,
              (lead(y) OVER w - y) / (lead(x) OVER w - x) AS s1 FROM kn WINDOW w AS (PARTITION BY symbol ORDER BY i)),
eq AS (SELECT symbol, i, n, h0, h1, 6 * (s1 - s0) AS d,
              CASE WHEN i = n - 2 THEN h0 - h1 * h1 / h0 ELSE h0 END AS a,
              2 * (h0 + h1) + CASE WHEN i = 1 THEN h0 * (h0 + h1) / h1 ELSE 0 END
                            + CASE WHEN i = n - 2 THEN h1 * (h0 + h1) / h0 ELSE 0 END AS b,
              CASE WHEN i = 1 THEN h1 - h0 * h0 / h1 ELSE h1 END AS c
       FROM hh WHERE i BETWEEN 1 AND n - 2),
fwd AS (SELECT symbol, i, b, c, d FROM eq WHERE i = 1
        UNION ALL
        SELECT eq.symbol, eq.i, eq.b - eq.a / fwd.b * fwd.c, eq.c, eq.d - eq.a / fwd.b * fwd.d
        FROM fwd JOIN eq ON eq.symbol = fwd.symbol AND eq.i = fwd.i + 1),
bwd AS (SELECT fwd.symbol, fwd.i, fwd.d / fwd.b AS m FROM fwd JOIN eq USING (symbol, i) WHERE fwd.i = eq.n - 2
        UNION ALL
        SELECT fwd.symbol, fwd.i, (fwd.d - fwd.c * bwd.m) / fwd.b
        FROM bwd JOIN fwd ON fwd.symbol = bwd.symbol AND fwd.i = bwd.i - 1),
mm AS (SELECT symbol, i, m FROM bwd
       UNION ALL
       SELECT e.symbol, 0, ((e.h0 + e.h1) * p.m - e.h0 * q.m) / e.h1
       FROM eq e JOIN bwd p ON p.symbol = e.symbol AND p.i = 1 JOIN bwd q ON q.symbol = e.symbol AND q.i = 2 WHERE e.i = 1
       UNION ALL
       SELECT e.symbol, e.n - 1, ((e.h0 + e.h1) * p.m - e.h1 * q.m) / e.h0
       FROM eq e JOIN bwd p ON p.symbol = e.symbol AND p.i = e.n - 2 JOIN bwd q ON q.symbol = e.symbol AND q.i = e.n - 3
       WHERE e.i = e.n - 2),
km AS (SELECT kn.symbol, kn.ts, kn.x, kn.y, mm.m FROM kn JOIN mm USING (symbol, i)),
around AS (
  SELECT l.symbol, l.ts, l.close, CAST(epoch(CAST(l.ts AS TIMESTAMP)) AS DOUBLE) AS x,
         p.x AS x0, p.y AS y0, p.m AS m0, q.x AS x1, q.y AS y1, q.m AS m1
  FROM {src} l ASOF LEFT JOIN km p ON p.symbol = l.symbol AND l.ts >= p.ts
               ASOF LEFT JOIN km q ON q.symbol = l.symbol AND l.ts <= q.ts),
cubic AS (
  SELECT symbol, ts, coalesce(close,
           m0 * pow(x1 - x, 3) / (6 * (x1 - x0)) + m1 * pow(x - x0, 3) / (6 * (x1 - x0))
           + (y0 / (x1 - x0) - m0 * (x1 - x0) / 6) * (x1 - x) + (y1 / (x1 - x0) - m1 * (x1 - x0) / 6) * (x - x0)) AS close
  FROM around)"""


def feature_sql(side: list[str], rates: list[str] = (), fill: str = "ffill") -> str:
    """CTE chain ending in ``feat`` (features + side closes + target).

    Side gaps are forward filled, or interpolated (cubic) and back filled;
    ``rates`` are differenced instead of divided.
    """
    sc = [f"{s}_close" for s in side]
    lags = ", ".join(f"lag({c}) OVER w AS p_{c}" for c in ["close", "volume", "obv"] + sc)
    side_pct = ", ".join((f"{c} - p_{c}" if c in rates else pct_change(c, f"p_{c}")) + f" AS {c}" for c in sc)
    keep = ["close", "volume"] + INDICATOR_COLS + sc
    rel = ", ".join(ratio(f"{c} - lvl", "lvl") + f" AS {c}" for c in ("ema_10", "ema_20", "psar"))
    norm = ", ".join(ratio(c, "lvl") + f" AS {c}" for c in ("macd", "macd_signal"))
    if fill == "ffill":
        ff = ", ".join(
            f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY sbar ROWS UNBOUNDED PRECEDING) AS {c}"
            for c in sc)
        aligned = """
al AS (
  SELECT surv.* EXCLUDE (""" + ", ".join(sc) + """), """ + ff + """
  FROM (SELECT * FROM surv LEFT JOIN panel USING (ts)) surv
),
"""
    else:
        parts = "\n  UNION ALL ".join(
            f"SELECT surv.symbol || '|{c}' AS symbol, ts, panel.{c} AS close FROM surv LEFT JOIN panel USING (ts)" for c in sc)
        back = ", ".join(f"max(CASE WHEN name = '{c}' THEN close END) AS {c}" for c in sc)
        aligned = f"""
gaps AS ({parts}),
{cubic_sql("gaps")},
full_ AS (SELECT split_part(symbol, '|', 1) AS symbol, split_part(symbol, '|', 2) AS name, ts,
                 first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS close FROM cubic),
al AS (SELECT surv.*, w.* EXCLUDE (symbol, ts)
       FROM surv JOIN (SELECT symbol, ts, {back} FROM full_ GROUP BY symbol, ts) w USING (symbol, ts)),
"""
    return side_panel_sql(side) + "," + aligned.lstrip("\n") + """
pv AS (
  SELECT al.*, close AS lvl, """ + lags + """
  FROM al WINDOW w AS (PARTITION BY symbol ORDER BY sbar)
),
st AS (
  SELECT symbol, ts, target,
         """ + pct_change("close", "p_close") + """ AS close,
         """ + pct_change("volume", "p_volume") + """ AS volume,
         """ + rel + """, """ + norm + """,
         """ + ratio("obv - p_obv", "lvl") + """ AS obv,
         """ + side_pct + """,
         """ + ", ".join(c for c in INDICATOR_COLS if c not in
                         ("ema_10", "ema_20", "psar", "macd", "macd_signal", "obv")) + """
  FROM pv
),
feat AS (
  SELECT symbol, ts, """ + ", ".join(keep) + """, target FROM st
  WHERE """ + " AND ".join(f"{c} IS NOT NULL" for c in keep) + """
)"""


def swings_sql(src: str = "b", order: int = 5, prefix: str = "") -> str:
    """CTE chain ending in ``{prefix}sw``: cleaned, labelled swings."""
    p = prefix
    return f"""
{p}sp AS (
  SELECT symbol, ts, bar_no, high, low,
         (lag(high, {order}) OVER w IS NOT NULL AND lead(high, {order}) OVER w IS NOT NULL) AS full_,
         max(high) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {order} PRECEDING AND 1 PRECEDING) AS hb,
         max(high) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 1 FOLLOWING AND {order} FOLLOWING) AS ha,
         min(low) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN {order} PRECEDING AND 1 PRECEDING) AS lb,
         min(low) OVER (PARTITION BY symbol ORDER BY bar_no ROWS BETWEEN 1 FOLLOWING AND {order} FOLLOWING) AS la
  FROM {src} WINDOW w AS (PARTITION BY symbol ORDER BY bar_no)
),
{p}raw AS (
  SELECT symbol, ts, high AS price, 'high' AS swing_type, 0 AS tord FROM {p}sp WHERE full_ AND high > hb AND high > ha
  UNION ALL
  SELECT symbol, ts, low AS price, 'low' AS swing_type, 1 AS tord FROM {p}sp WHERE full_ AND low < lb AND low < la
),
{p}ri AS (
  SELECT *, lag(swing_type) OVER (PARTITION BY symbol ORDER BY ts, tord) AS prev_t,
         row_number() OVER (PARTITION BY symbol ORDER BY ts, tord) AS i
  FROM {p}raw
),
{p}rr AS (
  SELECT *, sum(CASE WHEN prev_t IS NULL OR prev_t <> swing_type THEN 1 ELSE 0 END)
            OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
  FROM {p}ri
),
{p}cl AS (
  SELECT symbol, ts, price, swing_type, tord FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, run
              ORDER BY CASE WHEN swing_type = 'high' THEN -price ELSE price END, i) AS rk
    FROM {p}rr) t WHERE rk = 1
),
{p}sq AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, tord) - 1 AS k FROM {p}cl),
{p}lb AS (
  SELECT sq.*, lag(price, 2) OVER w AS level, lag(ts, 2) OVER w AS level_date,
         lag(ts) OVER w AS prev_ts, lag(price) OVER w AS prev_price,
         CASE WHEN lag(price, 2) OVER w IS NULL THEN (CASE WHEN swing_type = 'high' THEN 'H' ELSE 'L' END)
              WHEN swing_type = 'high' THEN (CASE WHEN price > lag(price, 2) OVER w THEN 'HH' ELSE 'LH' END)
              ELSE (CASE WHEN price > lag(price, 2) OVER w THEN 'HL' ELSE 'LL' END) END AS label
  FROM {p}sq sq WINDOW w AS (PARTITION BY symbol ORDER BY k)
),
{p}lb2 AS (
  SELECT lb.*, lag(label) OVER (PARTITION BY symbol ORDER BY k) AS prev_label FROM {p}lb lb
),
{p}lb3 AS (
  SELECT lb2.*,
         CASE WHEN label IN ('HH', 'HL') THEN 'long' WHEN label IN ('LH', 'LL') THEN 'short' END AS seq_dir,
         CASE WHEN prev_label IN ('HH', 'HL') THEN 'long' WHEN prev_label IN ('LH', 'LL') THEN 'short' END AS prev_dir,
         CASE WHEN label IN ('HH', 'HL') AND prev_label IN ('HH', 'HL') THEN 'up'
              WHEN label IN ('LH', 'LL') AND prev_label IN ('LH', 'LL') THEN 'down' END AS trend_sig,
         CASE WHEN k = 2 AND label IN ('HH', 'HL') THEN 'up'
              WHEN k = 2 AND label IN ('LH', 'LL') THEN 'down'
              WHEN k <> 2 AND label = 'HH' THEN 'up'
              WHEN k <> 2 AND label = 'LL' THEN 'down' END AS state_sig
  FROM {p}lb2 lb2
),
{p}lb4 AS (
  SELECT lb3.*,
         CASE WHEN seq_dir IS NOT NULL AND (prev_dir IS NULL OR prev_dir <> seq_dir) THEN k END AS run_start
  FROM {p}lb3 lb3
),
{p}lb5 AS (
  SELECT lb4.*,
         last_value(run_start IGNORE NULLS) OVER w AS run_from,
         coalesce(last_value(trend_sig IGNORE NULLS) OVER w, 'neutral') AS trend,
         last_value(state_sig IGNORE NULLS) OVER w AS state_after
  FROM {p}lb4 lb4 WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS UNBOUNDED PRECEDING)
),
{p}sw AS (
  SELECT symbol, ts, price, swing_type, label, level, level_date, prev_ts, prev_price, k, trend, seq_dir,
         CAST(CASE WHEN seq_dir IS NULL THEN 0 ELSE k - run_from + 1 END AS INTEGER) AS seq_count,
         lag(state_after) OVER (PARTITION BY symbol ORDER BY k) AS state_before
  FROM {p}lb5
)"""


SIGNALS = """
sig AS (
  SELECT symbol, k, ts AS swing_ts, price AS swing_price, level, level_date, prev_ts,
         CASE WHEN state_before = 'up' AND label = 'HH' THEN 'bos'
              WHEN state_before = 'up' AND label = 'LL' THEN 'choch'
              WHEN state_before = 'down' AND label = 'LL' THEN 'bos'
              WHEN state_before = 'down' AND label = 'HH' THEN 'choch' END AS type,
         CASE WHEN label = 'HH' THEN 'long' WHEN label = 'LL' THEN 'short' END AS direction
  FROM sw WHERE k >= 3
),
sig2 AS (SELECT * FROM sig WHERE type IS NOT NULL),
brk AS (
  SELECT s.symbol, s.k, arg_min(b.ts, b.ts) AS bts, arg_min(b.close, b.ts) AS bclose
  FROM sig2 s JOIN b ON b.symbol = s.symbol AND b.ts >= s.prev_ts AND b.ts <= s.swing_ts
   AND ((s.direction = 'long' AND b.close > s.level) OR (s.direction = 'short' AND b.close < s.level))
  GROUP BY s.symbol, s.k
),
signals AS (
  SELECT s.symbol, coalesce(brk.bts, s.swing_ts) AS ts, coalesce(brk.bclose, s.swing_price) AS price,
         s.level, s.level_date, s.type, s.direction
  FROM sig2 s LEFT JOIN brk USING (symbol, k)
)"""
