"""Exact ranks and quantiles without a whole group in one task.

``exact_rank`` orders the rows of each key by value: approximate quantiles
(a small array per key) cut the value axis into balanced buckets, bucket
sizes are prefix-summed on the small (key, bucket) table, and a row number
inside each bucket completes the rank.  Every sort holds one bucket only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candleflow.session import materialize

ROWS_PER_BUCKET = 500_000
MIN_BUCKETS = 16
MAX_BROADCAST_KEYS = 100_000
GROUP = 64          # bounds per lookup block (two-level search)


def bucket_count(df: DataFrame, key: str) -> int:
    """Buckets so that one bucket holds ~ROWS_PER_BUCKET rows of the largest
    key (one scalar from a distributed count)."""
    largest = df.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    return int(max(MIN_BUCKETS, -(-largest // ROWS_PER_BUCKET)))


def _bucket_of(bounds, v):
    """Number of (sorted) bounds below v: whole blocks of GROUP bounds whose
    last element is below v, plus the count inside the next block."""
    n = F.size(bounds)
    n_blocks = F.ceil(n / F.lit(GROUP)).cast("int")
    lasts = F.transform(F.sequence(F.lit(1), F.greatest(n_blocks, F.lit(1))),
                        lambda i: F.element_at(bounds, F.least(i * GROUP, n)))
    full = F.size(F.filter(lasts, lambda b: b < v))
    part = F.slice(bounds, full * GROUP + 1, GROUP)
    return F.when(n == 0, F.lit(0)).otherwise(full * GROUP + F.size(F.filter(part, lambda b: b < v)))


def exact_rank(df: DataFrame, key: str, value: str, out: str = "_rank",
               buckets: int | None = None, tiebreak=()) -> DataFrame:
    buckets = buckets or bucket_count(df, key)
    probs = [i / buckets for i in range(1, buckets)]
    accuracy = max(10_000, 4 * buckets)
    bounds = df.groupBy(key).agg(F.percentile_approx(value, probs, accuracy).alias("_bounds"))
    staged = df.join(bounds, key, "inner").withColumn("_b", _bucket_of(F.col("_bounds"), F.col(value)))
    staged = staged.drop("_bounds")
    counts = staged.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.select(key, "_b", F.coalesce(F.sum("_n").over(
        Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    w = Window.partitionBy(key, "_b").orderBy(value, *tiebreak)
    return (staged.join(offs, [key, "_b"], "inner")
            .withColumn(out, F.row_number().over(w) - 1 + F.col("_off"))
            .drop("_b", "_off"))


def exact_quantiles(long_df: DataFrame, key: str, value: str, probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles (pandas / ``percentile_cont``) per key.

    Rows are counted per distinct value first, so a value that half the rows
    share is one row; that table is range partitioned by (key, value) -- a key
    with most of the values is cut between values -- and written once.  Ranks
    are partition totals plus running counts inside a partition; only the few
    wanted ranks are picked.  Returns ``(key, q_<i> ...)``.
    """
    counts = long_df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    parts = materialize(counts.repartitionByRange(key, value).withColumn("_part", F.spark_partition_id()), "values")
    totals = parts.groupBy(key, "_part").agg(F.sum("_c").alias("_n"))
    ahead = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(key, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.withColumn("_lo", F.coalesce(F.sum("_c").over(inside), F.lit(0))) \
        .join(offsets, [key, "_part"]).withColumn("_lo", F.col("_lo") + F.col("_off"))
    # one row per key: the positions each quantile needs (floor and ceil of p * (n - 1))
    want = totals.groupBy(key).agg(F.sum("_n").alias("_n")).select(key, *[
        (F.lit(p) * (F.col("_n") - 1)).alias(f"_p{i}") for i, p in enumerate(probs)])
    hit = lambda at: (F.col("_lo") <= at) & (at < F.col("_lo") + F.col("_c"))
    want = materialize(want, "wanted")
    small = want.count() <= MAX_BROADCAST_KEYS  # else a join, which splits hot keys at run time
    found = ranked.join(F.broadcast(want) if small else want, key)
    out = found.groupBy(key).agg(*[x for i in range(len(probs)) for x in (
        F.max(F.when(hit(F.floor(f"_p{i}")), F.col(value))).alias(f"_a{i}"),
        F.max(F.when(hit(F.ceil(f"_p{i}")), F.col(value))).alias(f"_b{i}"),
        F.max(f"_p{i}").alias(f"_p{i}"))])
    return out.select(key, *[
        (F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (F.col(f"_p{i}") - F.floor(f"_p{i}"))).alias(f"q_{i}")
        for i in range(len(probs))])
