"""Scalar column helpers shared by all operators (JVM-side expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(n, d) -> Column:
    """Division for feature columns under the engine's null model.

    ``d = 0`` and ``n <> 0`` gives 0.0 (an infinite ratio is replaced by 0,
    as the feature transform does for the whole frame); ``0 / 0`` gives NULL
    (NaN, row later dropped); otherwise ``try_divide``.  Never NaN/Inf.
    """
    n, d = col(n), col(d)
    return (F.when(d.isNull() | n.isNull(), F.lit(None).cast("double"))
            .when((d == 0) & (n == 0), F.lit(None).cast("double"))
            .when(d == 0, F.lit(0.0))
            .otherwise(F.try_divide(n, d)))


def nan_to_null(c) -> Column:
    """NaN -> NULL at ingest; the engine never carries NaN."""
    c = col(c)
    return F.nanvl(c, F.lit(None).cast("double"))


def rnd(c, scale: int = 6) -> Column:
    """Output rounding for value checks (same rule in the SQL oracle)."""
    return F.round(col(c), scale)


def full_window(c, w, k: int, value: Column) -> Column:
    """``value`` only where the k-row frame ``w`` holds k non-null ``c``.

    Spark emits partial frames; pandas rolling needs ``min_periods = k``.
    """
    return F.when(F.count(col(c)).over(w) == k, value)


def confidence_label(c) -> Column:
    """Fixed thresholds: >= .70 Strong, >= .60 Moderate, else Weak."""
    c = col(c)
    return F.when(c >= 0.70, "Strong").when(c >= 0.60, "Moderate").otherwise("Weak")


def position_size(c) -> Column:
    """Sizing from confidence: full at >= .70, half at >= .60, else flat."""
    c = col(c)
    return F.when(c >= 0.70, F.lit(1.0)).when(c >= 0.60, F.lit(0.5)).otherwise(F.lit(0.0))
