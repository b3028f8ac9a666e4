"""Predictions and their realised outcomes.

* ``asof_forward``: first bar at or after ``probe_ts`` per series -- union of
  bars and probes ordered by (ts, probe-before-bar), then a back-carry of the
  bar columns (two-level scan, no theta join, no per-row loop);
* outcomes: entry price = stored price, else the bar close on that date;
  exit = as-of forward bar ``horizon_days`` calendar days later; P&L,
  return, correctness, open/closed status;
* display projections with exact money/percent formatting from integer
  cents (no engine-specific rounding of ties).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleflow.functions.scalar import confidence_label
from candleflow.plans.series import KEY, carry_next, with_bar_no

HORIZON_DAYS = 10      # outcome horizon in calendar days


def predictions_from_bars(ind: DataFrame) -> DataFrame:
    """Deterministic prediction table from bars with ``sma20``.

    prediction = close > sma20; confidence = clip(0.5 + |close/sma20 - 1|,
    0.5, 1); entry_price is left NULL on every third bar so the bar-close
    fallback is exercised.
    """
    conf = F.least(F.greatest(F.lit(0.5) + F.abs(F.col("close") / F.col("sma20") - 1), F.lit(0.5)),
                   F.lit(1.0))
    return (ind.filter(F.col("sma20").isNotNull())
            .select(KEY, "ts",
                    (F.col("close") > F.col("sma20")).cast("int").alias("prediction"),
                    conf.alias("confidence"),
                    F.lit(HORIZON_DAYS).alias("horizon_days"),
                    F.when(F.col("bar_no") % 3 != 0, F.col("close")).alias("entry_price")))


def asof_forward(probes: DataFrame, bars: DataFrame, probe_ts: str, cols: list[str],
                 prefix: str = "exit_", key_ts: str = "ts") -> DataFrame:
    """Attach the first bar with ``ts >= probe_ts`` (same symbol) to each probe.

    ``(symbol, key_ts)`` identifies a probe (and ``probe_ts`` must be unique
    per symbol).  Probe and bar times keep the type of the bars' ``ts`` (dates or
    timestamps).  Probes sort before a bar of the same time, so the
    back-carry from a probe reaches that bar.
    """
    at = bars.schema["ts"].dataType
    left = probes.select(KEY, F.col(probe_ts).cast(at).alias("ts"),
                         F.col(key_ts).alias("_pts"), F.lit(0).alias("_is_bar"),
                         *[F.lit(None).cast("double").alias(c) for c in cols],
                         F.lit(None).cast(at).alias("_bts"))
    right = bars.select(KEY, "ts", F.lit(None).cast(probes.schema[key_ts].dataType).alias("_pts"),
                        F.lit(1).alias("_is_bar"), *cols, F.col("ts").alias("_bts"))
    u = with_bar_no(left.unionByName(right), tiebreak=["_is_bar"])
    u = carry_next(u, cols + ["_bts"], [f"{prefix}{c}" for c in cols] + [f"{prefix}ts"])
    found = u.filter(F.col("_is_bar") == 0).select(KEY, F.col("_pts").alias(key_ts), f"{prefix}ts",
                                                    *[f"{prefix}{c}" for c in cols])
    return probes.join(found, [KEY, key_ts], "left")


def prediction_outcomes(preds: DataFrame, bars: DataFrame, horizon_days: int = HORIZON_DAYS) -> DataFrame:
    """Outcome per prediction (open when entry or exit is unknown)."""
    at = bars.select(KEY, "ts", F.col("close").alias("_bar_close"))
    daily = bars.schema["ts"].dataType.typeName() == "date"
    probe = F.date_add(F.col("ts"), horizon_days) if daily else \
        F.col("ts") + F.make_dt_interval(F.lit(horizon_days))
    p = (preds.join(at, [KEY, "ts"], "left")
         .withColumn("entry", F.coalesce(F.col("entry_price"), F.col("_bar_close")))
         .withColumn("_probe", probe))
    p = asof_forward(p, bars, "_probe", ["close"])
    up = F.col("prediction") == 1
    has = F.col("entry").isNotNull() & F.col("exit_close").isNotNull()
    pnl = F.col("exit_close") - F.col("entry")
    return p.select(
        KEY, F.col("ts").alias("date"),
        F.when(up, "UP").otherwise("DOWN").alias("direction"),
        "confidence",
        F.col("entry").alias("entry_price"),
        F.when(has, F.col("exit_close")).alias("exit_price"),
        F.when(has, F.try_divide(pnl, F.col("entry"))).alias("return_pct"),
        F.when(has, pnl).alias("pnl"),
        F.when(has, up == (F.col("exit_close") > F.col("entry"))).alias("correct"),
        F.when(has, "closed").otherwise("open").alias("status"))


def pnl_summary(outcomes: DataFrame) -> DataFrame:
    """A1: total P&L, hit rate and mean return over closed outcomes."""
    closed = outcomes.filter(F.col("status") == "closed")
    return closed.groupBy(KEY).agg(
        F.sum("pnl").alias("total_pnl"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
        F.avg("return_pct").alias("avg_return"),
        F.count(F.lit(1)).alias("n_closed"))


def _grouped_int(n) -> F.Column:
    return F.format_number(n, 0)


def money(x, signed: bool = False) -> F.Column:
    """'$1,234.56' (or '$+12.34' when signed) from integer cents."""
    cents = F.floor(F.abs(x) * 100 + 0.5).cast("long")
    body = F.concat(_grouped_int(F.floor(cents / 100)), F.lit("."),
                    F.lpad((cents % 100).cast("string"), 2, "0"))
    sign = F.when(x < 0, "-").otherwise("+" if signed else "")
    return F.concat(F.lit("$"), sign, body)


def percent(x, signed: bool = True) -> F.Column:
    """'+1.23%' from integer basis points."""
    bp = F.floor(F.abs(x) * 10000 + 0.5).cast("long")
    body = F.concat((bp / 100).cast("long").cast("string"), F.lit("."),
                    F.lpad((bp % 100).cast("string"), 2, "0"))
    sign = F.when(x < 0, "-").otherwise("+" if signed else "")
    return F.concat(sign, body, F.lit("%"))


def results_table(outcomes: DataFrame) -> DataFrame:
    """Display projection, newest first."""
    conf = F.concat(F.floor(F.col("confidence") * 100 + 0.5).cast("long").cast("string"),
                    F.lit("% "), confidence_label("confidence"))
    return outcomes.select(
        KEY,
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.col("direction"),
        conf.alias("confidence"),
        F.when(F.col("entry_price").isNull(), "-").otherwise(money(F.col("entry_price"))).alias("entry"),
        F.when(F.col("exit_price").isNull(), "pending").otherwise(money(F.col("exit_price"))).alias("exit"),
        F.when(F.col("return_pct").isNull(), "-").otherwise(percent(F.col("return_pct"))).alias("return_pct"),
        F.when(F.col("pnl").isNull(), "-").otherwise(money(F.col("pnl"), True)).alias("pnl"),
        F.when(F.col("status") == "open", "open")
         .when(F.col("correct"), "right").otherwise("wrong").alias("result"),
    ).orderBy(F.col("date").desc(), KEY)


def dedupe_last(df: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row per key, the last arrival wins (an aggregation with
    map-side partial ``max_by``, not a window over whole groups)."""
    others = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.col(arrival)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, "_row.*")
