"""Profiling over a wide feature table: counts, describe, grouped ranges,
range extremes, correlations (with the label and pairwise), pruning lists.

Wide -> long with ``unpivot`` so every statistic is one grouped aggregation
over ``(feature, value)`` with map-side partial aggregation; pairwise
correlations are sums of masked per-task Gramians.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleflow.plans.ranking import exact_quantiles

CORR_THRESHOLD = 0.9
IMPORTANCE_THRESHOLD = 0.005


def long_form(df: DataFrame, cols: list[str], ids: list[str] = ()) -> DataFrame:
    return df.unpivot(list(ids), cols, "feature", "value")


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, std, min, 25/50/75 %, max per feature (exact quartiles)."""
    lf = long_form(df.select(*cols), cols).filter(F.col("value").isNotNull())
    stats = lf.groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    q = exact_quantiles(lf, "feature", "value", [0.25, 0.5, 0.75])
    return (stats.join(q, "feature")
            .select("feature", "count", "mean", "std", "min", F.col("q_0").alias("p25"),
                    F.col("q_1").alias("p50"), F.col("q_2").alias("p75"), "max"))


def feature_groups(cols: list[str]) -> dict[str, list[str]]:
    """Name-pattern groups (plan-time list comprehension over columns)."""
    price = [c for c in cols if any(k in c for k in ("close", "ema", "psar"))
             and not c.endswith("_close") and c != "close"]
    bounded = [c for c in cols if c in ("rsi", "stoch_k", "adosc", "adx", "dmi_pos", "dmi_neg")]
    unbounded = [c for c in cols if c in ("macd", "macd_signal", "cci", "roc")]
    volume = [c for c in cols if c in ("volume", "obv")]
    extra = [c for c in cols if c.endswith("_close")]
    return {"price": price + (["close"] if "close" in cols else []), "bounded": bounded,
            "unbounded": unbounded, "volume": volume, "extra_market": extra}


def feature_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min, max, mean, std, range per feature within its group."""
    groups = feature_groups(cols)
    mapping = [(g, c) for g, cs in groups.items() for c in cs]
    spark = df.sparkSession
    gdf = spark.createDataFrame(mapping, "grp string, feature string")
    lf = long_form(df.select(*cols), cols)
    stats = lf.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"),
                                      F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return (stats.join(F.broadcast(gdf), "feature")
            .withColumn("range", F.col("max") - F.col("min"))
            .select("grp", "feature", "min", "max", "mean", "std", "range"))


def range_extremes(df: DataFrame, cols: list[str], k: int = 5) -> DataFrame:
    """The k largest and k smallest feature ranges, with max/min ratio.

    The range table has one row per feature column (bounded by the schema),
    so its ranking windows are tiny.
    """
    from pyspark.sql import Window
    lf = long_form(df.select(*cols), cols)
    rng = lf.groupBy("feature").agg((F.max("value") - F.min("value")).alias("range"))
    edge = rng.agg(F.max("range").alias("_top"), F.min("range").alias("_low"))
    best = F.col("range").desc()
    parts = []
    for kind, by in (("largest", best), ("smallest", F.col("range").asc())):
        few = rng.orderBy(by, "feature").limit(k)  # at most k rows are ranked
        rank = F.row_number().over(Window.partitionBy("kind").orderBy(by, "feature"))
        parts.append(few.withColumn("kind", F.lit(kind)).withColumn("rank", rank))
    out = parts[0].unionByName(parts[1]).crossJoin(F.broadcast(edge))  # one row
    return out.select("kind", F.col("rank").cast("int").alias("rank"), "feature", "range",
                      (F.col("_top") / F.col("_low")).alias("ratio"))


def target_corr(df: DataFrame, cols: list[str], target: str = "target") -> DataFrame:
    """Pearson correlation of each feature with the label (pairwise complete)."""
    lf = long_form(df.select(*cols, F.col(target).cast("double").alias("_t")), cols, ["_t"])
    lf = lf.filter(F.col("value").isNotNull() & F.col("_t").isNotNull())
    return lf.groupBy("feature").agg(F.corr("value", "_t").alias("corr"))


def pairwise_corr(df: DataFrame, cols: list[str]) -> DataFrame:
    """A10: Pearson correlation of every pair of columns over the rows that have
    both (``feature_a``, ``feature_b``, ``n``, ``corr``; i < j in column order).

    Every task adds up masked Gramians of its rows (per pair: rows, sums,
    squares and products, each over the rows of that pair) on values less a
    common shift, and hands on a row per pair; Spark adds those.  A pair with
    fewer than two rows, or without spread, has a NULL correlation.
    """
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    names, p = list(cols), len(cols)
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"c{i}") for i, c in enumerate(names)])
    means = values.agg(*[F.avg(f"c{i}").alias(f"c{i}") for i in range(p)]).first()
    shift = np.array([m or 0.0 for m in means])  # correlation does not depend on it, rounding does

    def gramians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((4, p, p))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]) - shift
            there = ~np.isnan(x)
            mask, x = there.astype(np.float64), np.where(there, x, 0.0)
            sums += np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])
        i, j = np.triu_indices(p, 1)
        n, s, q, xy = sums
        yield pa.RecordBatch.from_arrays(
            [pa.array(v) for v in (i.astype(np.int32), j.astype(np.int32), n[i, j], s[i, j], s[j, i], q[i, j], q[j, i],
                                   xy[i, j])], ["i", "j", "n", "a", "b", "aa", "bb", "ab"])

    schema = "i int, j int, " + ", ".join(f"{c} double" for c in ("n", "a", "b", "aa", "bb", "ab"))
    total = values.mapInArrow(gramians, schema).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")])
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    va, vb = n * F.col("aa") - a * a, n * F.col("bb") - b * b
    spread = (n > 1) & (va > 1e-14 * n * F.col("aa")) & (vb > 1e-14 * n * F.col("bb"))
    corr = F.when(spread, (n * F.col("ab") - a * b) / F.sqrt(va * vb))
    listed = F.array(*[F.lit(c) for c in names])
    return total.select(F.get(listed, F.col("i")).alias("feature_a"), F.get(listed, F.col("j")).alias("feature_b"),
                        n.cast("long").alias("n"), corr.alias("corr"))


def corr_pairs(df: DataFrame, cols: list[str], threshold: float = CORR_THRESHOLD) -> DataFrame:
    """A10: |Pearson corr| of every ordered pair (i < j) above ``threshold``,
    each over the rows that have both."""
    pairs = pairwise_corr(df, cols).withColumn("corr", F.abs("corr"))
    return pairs.filter(F.col("corr") > threshold).select("feature_a", "feature_b", "corr")


def corr_drop(pairs: DataFrame) -> DataFrame:
    """Every later column of a highly correlated pair."""
    return pairs.select(F.col("feature_b").alias("feature")).distinct()


def importance_drop(importances: DataFrame, threshold: float = IMPORTANCE_THRESHOLD) -> DataFrame:
    """Features whose importance is below the threshold."""
    return importances.filter(F.col("importance") < threshold).select("feature")


def kept_features(all_features: DataFrame, *drop_lists: DataFrame) -> DataFrame:
    """Features not in the union of the drop lists."""
    dropped = drop_lists[0]
    for d in drop_lists[1:]:
        dropped = dropped.unionByName(d)
    return all_features.join(dropped.distinct(), "feature", "left_anti")
