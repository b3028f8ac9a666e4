"""Leakage-safe dataset operators and classification metrics as DataFrames.

One model is fitted over the whole panel, so splits and folds are cut on the
panel's *calendar* (its distinct timestamps in order): every series is cut at
the same dates and no training row is later than a test row minus the
embargo.  The calendar is numbered with the distributed position index; only
the cut dates (a few scalars) reach the driver and become literal filters, so
no split needs a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candleflow.plans.series import BAR, KEY, with_bar_no
from candleflow.session import materialize

TEST_SIZE = 0.2          # chronological hold-out fraction (of the calendar)
EMBARGO = 10             # calendar positions dropped before the hold-out (label horizon)
HALFLIFE_FRACTION = 0.33
TRAINING_YEARS = 12
WF_SPLITS, WF_GAP = 5, 10


def labelled_rows(df: DataFrame, target: str = "target") -> DataFrame:
    """P5: rows with a label."""
    return df.dropna(subset=[target])


def training_window(df: DataFrame, years: int = TRAINING_YEARS, ref_ts=None) -> DataFrame:
    """Rows newer than ``ref - years`` (``ref`` = newest row by default)."""
    if ref_ts is None:
        ref_ts = df.agg(F.max("ts")).first()[0]
    return df.filter(F.col("ts") >= F.add_months(F.lit(ref_ts).cast("date"), -12 * years))


def calendar(df: DataFrame) -> DataFrame:
    """``(ts, pos)``: the distinct timestamps of all series, numbered 0.."""
    days = df.select("ts").distinct().withColumn(KEY, F.lit("calendar"))
    return with_bar_no(days, out="pos").select("ts", "pos")


def _dates(cal: DataFrame, n: int, positions: list[int]) -> dict[int, object]:
    """Timestamps at the given positions (a few rows); None past the end."""
    inside = sorted({p for p in positions if 0 <= p < n})
    found = {r["pos"]: r["ts"] for r in cal.filter(F.col("pos").isin(inside)).collect()} if inside else {}
    return {p: found.get(p) for p in positions}


def _before(ts) -> Column:
    """Rows before a cut date; a cut past the end lets every row through."""
    return F.lit(True) if ts is None else F.col("ts") < F.lit(ts)


def chrono_split(df: DataFrame, test_size: float = TEST_SIZE, embargo: int = EMBARGO) -> DataFrame:
    """ML1/ML2: ``split`` in {train, embargo, test}; test = the newest
    ceil(f n) of the panel's n dates, embargo = the dates before them."""
    cal = materialize(calendar(df), "calendar")
    n = cal.count()
    first = n - math.ceil(n * test_size)
    at = _dates(cal, n, [first, first - embargo])
    is_train = _before(at[first - embargo]) if first - embargo >= 0 else F.lit(False)
    return df.withColumn("split", F.when(is_train, "train").when(_before(at[first]), "embargo").otherwise("test"))


def sample_weights(train: DataFrame, fraction: float = HALFLIFE_FRACTION) -> DataFrame:
    """ML3: exp(linspace(-m/h, 0, m)) over the m training dates, h = max(int(m f), 1),
    normalised to mean 1 over the rows.

    The join adds each row's date position; the calendar has one row per date
    and AQE broadcasts it while its measured size is small.
    """
    cal = materialize(calendar(train), "calendar")
    m = cal.count()
    h = max(math.floor(m * fraction), 1)
    step = (m / h) / (m - 1) if m > 1 else 0.0
    w = train.join(cal, "ts").withColumn("weight", F.exp(F.lit(-m / h) + F.col("pos") * F.lit(step))).drop("pos")
    mean = w.agg(F.avg("weight")).first()[0] or 1.0
    return w.withColumn("weight", F.col("weight") / F.lit(mean))


def class_weights(weighted: DataFrame, target: str = "target") -> DataFrame:
    """ML4: balanced class weight n / (2 n_class) over the pooled rows, times
    the decay weight (two counts reach the driver)."""
    n = {r[target]: r["count"] for r in weighted.groupBy(target).count().collect()}
    total = float(sum(n.values()))
    cw = F.lit(None).cast("double")
    for cls, k in sorted(n.items()):
        cw = F.when(F.col(target) == cls, F.lit(total / (2.0 * k))).otherwise(cw)
    return weighted.withColumn("class_weight", cw).withColumn("weight", F.col("weight") * F.col("class_weight"))


def fold_roles(train: DataFrame, k: int, gap: int, cal: DataFrame | None = None) -> list[Column]:
    """For every fold, the role (train / test / NULL) of a row by its date:
    K expanding windows of n // (K + 1) test dates with ``gap`` dates before.
    Callers filter one copy of the rows by these conditions."""
    cal = cal if cal is not None else materialize(calendar(train), "calendar")
    n = cal.count()
    t = n // (k + 1)
    starts = [n - (k - i) * t for i in range(k)]
    at = _dates(cal, n, [p for s in starts for p in (s - gap, s, s + t)])
    roles = []
    for s in starts:
        test = ~_before(at[s]) & _before(at[s + t]) if t else F.lit(False)
        fit = _before(at[s - gap]) if s - gap > 0 else F.lit(False)
        roles.append(F.when(test, "test").when(fit, "train"))
    return roles


def _with_folds(train: DataFrame, roles: list[Column]) -> DataFrame:
    out = train.withColumn("_r", F.explode(F.array(*[
        F.struct(F.lit(i).alias("fold"), r.alias("role")) for i, r in enumerate(roles)])))
    return out.withColumns({"fold": F.col("_r.fold"), "role": F.col("_r.role")}).drop("_r") \
              .filter(F.col("role").isNotNull())


def walk_forward_folds(train: DataFrame, k: int = WF_SPLITS, gap: int = WF_GAP) -> DataFrame:
    """ML5: expanding-window folds with a gap, as rows with ``fold`` and ``role``
    (pass narrow rows: every row is repeated per fold)."""
    return _with_folds(train, fold_roles(train, k, gap))


def calibration_roles(train: DataFrame) -> list[Column]:
    """ML6: K = 3 from 40 dates on, else 2; gap = min(10, max(0, n // (K + 1) - 1))."""
    cal = materialize(calendar(train), "calendar")
    n = cal.count()
    k = 3 if n >= 40 else 2
    return fold_roles(train, k, min(10, max(0, n // (k + 1) - 1)), cal)


def calibration_folds(train: DataFrame) -> DataFrame:
    return _with_folds(train, calibration_roles(train))


def fold_summary(folds: DataFrame) -> DataFrame:
    return folds.groupBy(KEY, "fold", "role").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# ------------------------------------------------------------------ metrics

def confusion(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.sum(((F.col(y) == 1) & (F.col(p) == 1)).cast("long")).alias("tp"),
        F.sum(((F.col(y) == 0) & (F.col(p) == 1)).cast("long")).alias("fp"),
        F.sum(((F.col(y) == 1) & (F.col(p) == 0)).cast("long")).alias("fn"),
        F.sum(((F.col(y) == 0) & (F.col(p) == 0)).cast("long")).alias("tn"))


def _div0(n, d):
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def binary_metrics(df: DataFrame, y: str = "target", p: str = "prediction", by=(KEY,)) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on zero division)."""
    c = confusion(df, y, p, list(by))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    prec, rec = _div0(tp, tp + fp), _div0(tp, tp + fn)
    return c.select(*by, _div0(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall"),
                    _div0(2 * tp, 2 * tp + fp + fn).alias("f1"),
                    (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"))


def class_report(df: DataFrame, y: str = "target", p: str = "prediction") -> DataFrame:
    """Per-class precision / recall / F1 / support, from one confusion row."""
    c = confusion(df.withColumn("_all", F.lit(0)), y, p, ["_all"])
    per_class = F.array(*[F.struct(F.lit(cls).alias("class"), F.col(hit).cast("double").alias("hit"),
                                   F.col(wrong).cast("double").alias("wrong"),
                                   F.col(missed).cast("double").alias("missed"))
                          for cls, hit, wrong, missed in ((0, "tn", "fn", "fp"), (1, "tp", "fp", "fn"))])
    r = c.select(F.explode(per_class).alias("c")).select("c.*")
    hit, wrong, missed = F.col("hit"), F.col("wrong"), F.col("missed")
    return r.select("class", _div0(hit, hit + wrong).alias("precision"), _div0(hit, hit + missed).alias("recall"),
                    _div0(2 * hit, 2 * hit + wrong + missed).alias("f1"),
                    (hit + missed).cast("long").alias("support"))


def roc_auc(df: DataFrame, y: str = "target", score: str = "score", by: str = KEY,
            one_class: float | None = 0.5) -> DataFrame:
    """Exact ROC-AUC with average ranks for ties (Mann-Whitney).

    Rows are first counted per distinct score.  That table is range
    partitioned by (key, score) -- a key with most of the scores is cut
    between scores -- and written once; the negatives below a score are the
    partition totals before it plus a running sum inside its partition.  A
    key with one class only gets ``one_class``.
    """
    g = df.groupBy(by, score).agg(F.sum(F.col(y).cast("double")).alias("_pos"),
                                  F.sum((1 - F.col(y)).cast("double")).alias("_neg"))
    parts = materialize(g.repartitionByRange(by, score).withColumn("_part", F.spark_partition_id()), "scores")
    # one row per key and partition
    totals = parts.groupBy(by, "_part").agg(F.sum("_neg").alias("_n"))
    ahead = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(by, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0.0)).alias("_off"))
    inside = Window.partitionBy(by, "_part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_neg").over(inside), F.lit(0.0))
    cum = parts.withColumn("_below", below).join(offsets, [by, "_part"])
    agg = cum.groupBy(by).agg(
        F.sum(F.col("_pos") * (F.col("_off") + F.col("_below") + 0.5 * F.col("_neg"))).alias("_u"),
        F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    auc = F.when((F.col("_P") == 0) | (F.col("_N") == 0), F.lit(one_class).cast("double")) \
        .otherwise(F.col("_u") / (F.col("_P") * F.col("_N")))
    return agg.select(by, auc.alias("roc_auc"))
