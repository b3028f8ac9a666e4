"""Physical layout for ordered work over a panel of series.

The reference orders one series in memory.  A panel can hold one symbol with
a third of all bars, so "one window partition per symbol" would put that
symbol in a single task.  Everything ordered in this engine therefore goes
through three building blocks that never need a whole series in one task:

``with_bar_no``
    positional index per symbol by a two-level prefix sum: count bars per
    (symbol, coarse time bucket) -> running offset over the small count table
    -> ``row_number`` inside each bucket.  Parallel over buckets.

``over_chunks``
    bounded windows (lag/lead/rolling-k) partitioned by ``(symbol, chunk)``
    where ``chunk = bar_no div chunk_bars``; the last ``lookback`` bars of a
    chunk are copied into the next chunk (and the first ``lookahead`` bars
    into the previous one), results are kept only for home rows.  Exact for
    any frame inside ``[-lookback, +lookahead]``.

``running_sum`` / ``carry_last`` / ``carry_next`` / ``linear_recurrence``
    unbounded scans: an in-chunk (or in-block) scan plus a carry computed on
    the small per-chunk (per-block) table and joined back.

All helper columns start with ``_`` and are dropped before returning.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "symbol"
TS = "ts"
BAR = "bar_no"
CHUNK = "_chunk"

# Bars per chunk for bounded windows.  One task sorts at most this many rows
# (plus halo); small series stay one chunk per symbol.  Read at call time
# (``set_chunk_bars``) so tests can force many chunks on small data.
DEFAULT_CHUNK_BARS = 1 << 18
_CHUNK_BARS = [DEFAULT_CHUNK_BARS]


def set_chunk_bars(n: int) -> int:
    """Set the chunk length used when callers pass none; returns the old one."""
    old = _CHUNK_BARS[0]
    _CHUNK_BARS[0] = int(n)
    return old


def _cb(chunk_bars):
    return int(chunk_bars) if chunk_bars else _CHUNK_BARS[0]
# Coarse time bucket for the bar-number prefix sum (~194 days).
DEFAULT_BUCKET_SECONDS = 1 << 24


def _epoch_seconds(ts: str) -> Column:
    return F.unix_seconds(F.col(ts).cast("timestamp"))


def with_bar_no(df: DataFrame, key: str = KEY, ts: str = TS, out: str = BAR,
                bucket_seconds: int = DEFAULT_BUCKET_SECONDS, tiebreak=()) -> DataFrame:
    """0-based position of each row in its series, ordered by ``ts`` (then
    ``tiebreak`` columns).

    ``(key, ts, *tiebreak)`` must be unique.  No task ever sees more than one
    (symbol, bucket) group; the bucket count table is tiny and is joined
    back (AQE turns it into a broadcast when its runtime size allows).
    """
    bkt = F.floor(_epoch_seconds(ts) / F.lit(bucket_seconds)).alias("_bkt")
    staged = df.withColumn("_bkt", bkt)
    counts = staged.groupBy(key, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        key, "_bkt",
        F.coalesce(F.sum("_n").over(
            Window.partitionBy(key).orderBy("_bkt")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    in_bucket = Window.partitionBy(key, "_bkt").orderBy(ts, *tiebreak)
    return (staged.join(offsets, [key, "_bkt"], "inner")
            .withColumn(out, (F.row_number().over(in_bucket) - 1 + F.col("_off")).cast("long"))
            .drop("_bkt", "_off"))


def chunk_window(key: str = KEY) -> Window:
    return Window.partitionBy(key, CHUNK).orderBy(BAR)


def over_chunks(df: DataFrame, fn: Callable[[DataFrame, Window], DataFrame],
                lookback: int, lookahead: int = 0, key: str = KEY,
                chunk_bars: int | None = None) -> DataFrame:
    """Apply bounded-window logic ``fn(df, w)`` partitioned by (key, chunk).

    ``w`` is ``partitionBy(key, _chunk).orderBy(bar_no)``; ``fn`` may use any
    frame or lag/lead that stays within ``lookback`` rows behind and
    ``lookahead`` rows ahead (chained windows add up).  Requires ``bar_no``.
    """
    chunk_bars = _cb(chunk_bars)
    if lookback >= chunk_bars or lookahead >= chunk_bars:
        raise ValueError("halo must be smaller than the chunk")
    home = F.floor(F.col(BAR) / F.lit(chunk_bars))
    pos = F.col(BAR) - home * F.lit(chunk_bars)
    copies = F.array(
        home,
        F.when(pos >= F.lit(chunk_bars - lookback), home + 1),
        F.when((pos < F.lit(lookahead)) & (home > 0), home - 1))
    staged = (df.withColumn("_home", home)
              .withColumn(CHUNK, F.explode(F.filter(copies, lambda x: x.isNotNull()))))
    out = fn(staged, chunk_window(key))
    return out.filter(F.col(CHUNK) == F.col("_home")).drop(CHUNK, "_home")


def _with_chunk(df: DataFrame, chunk_bars) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(BAR) / F.lit(_cb(chunk_bars))))


def running_sum(df: DataFrame, value: str | Column, out: str, key: str = KEY,
                chunk_bars: int | None = None) -> DataFrame:
    """Cumulative sum per series (nulls count as 0), two-level scan."""
    v = F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0.0))
    staged = _with_chunk(df, chunk_bars).withColumn("_v", v)
    w_in = chunk_window(key).rowsBetween(Window.unboundedPreceding, 0)
    totals = staged.groupBy(key, CHUNK).agg(F.sum("_v").alias("_tot"))
    offs = totals.select(key, CHUNK, F.coalesce(F.sum("_tot").over(
        Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0.0)).alias("_off"))
    return (staged.withColumn("_in", F.sum("_v").over(w_in))
            .join(offs, [key, CHUNK], "inner")
            .withColumn(out, F.col("_in") + F.col("_off"))
            .drop("_v", "_in", "_off", CHUNK))


def carry_last(df: DataFrame, value, out=None, key: str = KEY,
               chunk_bars: int | None = None) -> DataFrame:
    """Forward fill: last non-null value at or before each bar.

    ``value``/``out`` may be lists: all columns share one chunk table, one
    join and one window pass.
    """
    return _carry(df, value, out, key, chunk_bars, forward=True)


def carry_next(df: DataFrame, value, out=None, key: str = KEY,
               chunk_bars: int | None = None) -> DataFrame:
    """Back fill: first non-null value at or after each bar.

    Uses a reversed order with an unbounded-preceding frame; a frame ending
    at unboundedFollowing would be quadratic.
    """
    return _carry(df, value, out, key, chunk_bars, forward=False)


def _carry(df, value, out, key, chunk_bars, forward):
    values = [value] if isinstance(value, str) else list(value)
    outs = values if out is None else ([out] if isinstance(out, str) else list(out))
    staged = _with_chunk(df, chunk_bars)
    order = F.col(BAR) if forward else F.col(BAR).desc()
    w_in = Window.partitionBy(key, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    pick = F.max_by if forward else F.min_by
    # per chunk: the edge (last / first) non-null value of every column
    per_chunk = staged.groupBy(key, CHUNK).agg(*[
        pick(F.col(v), F.when(F.col(v).isNotNull(), F.col(BAR))).alias(f"_edge{i}")
        for i, v in enumerate(values)])
    c_order = F.col(CHUNK) if forward else F.col(CHUNK).desc()
    w_c = Window.partitionBy(key).orderBy(c_order).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(key, CHUNK, *[
        F.last(f"_edge{i}", ignorenulls=True).over(w_c).alias(f"_prev{i}")
        for i in range(len(values))])
    inner = staged
    for i, v in enumerate(values):
        inner = inner.withColumn(f"_in{i}", F.last(F.col(v), ignorenulls=True).over(w_in))
    joined = inner.join(carry, [key, CHUNK], "inner")
    for i, o in enumerate(outs):
        joined = joined.withColumn(o, F.coalesce(F.col(f"_in{i}"), F.col(f"_prev{i}")))
    return joined.drop(CHUNK, *[f"_in{i}" for i in range(len(values))],
                       *[f"_prev{i}" for i in range(len(values))])


def block_size(q: float) -> int:
    """Block length B with q**B < 1e-17 so two carry terms are exact."""
    return max(2, int(math.ceil(40.0 / -math.log(q))))


def linear_recurrence(df: DataFrame, terms: dict, key: str = KEY) -> DataFrame:
    """``y_t = q * y_{t-1} + c_t`` per series, for each ``out -> (q, c)``.

    ``c`` is a non-null Column (use 0 before the seed bar; ``y_{-1} = 0``) or
    a callable ``f(w_blk) -> Column`` for seed values that need a frame; such
    frames must end inside the first block (seeds sit at small bar numbers).

    All terms share one block layout of B bars.  Inside a block
    ``local_j = q^j * sum_{i<=j} c_i q^-i`` is a bounded cumulative window;
    the value entering block b is ``E_{b-1} + q^B E_{b-2}`` where ``E`` is
    the local value at a block's last bar -- computed by an aggregation over
    the small block table, so no ordered pass ever spans a whole series.
    ``y = local + q^(j+1) * carry``.
    """
    names = list(terms)
    qs = [float(terms[n][0]) for n in names]
    for q in qs:
        if not 0.0 < q < 1.0:
            raise ValueError("q must be in (0, 1)")
    B = max(block_size(q) for q in qs)
    for q in qs:
        if B * -math.log(q) > 650:
            raise ValueError("terms with very different q need separate passes")
    staged = (df.withColumn("_blk", F.floor(F.col(BAR) / F.lit(B)))
              .withColumn("_j", F.col(BAR) - F.col("_blk") * F.lit(B)))
    w_blk = Window.partitionBy(key, "_blk").orderBy(BAR)
    staged = staged.withColumns({
        f"_c{i}": (terms[name][1](w_blk) if callable(terms[name][1]) else terms[name][1])
        for i, name in enumerate(names)})
    cum = w_blk.rowsBetween(Window.unboundedPreceding, 0)
    staged = staged.withColumns({
        f"_loc{i}": F.pow(F.lit(q), F.col("_j")) *
        F.sum(F.col(f"_c{i}") * F.pow(F.lit(q), -F.col("_j"))).over(cum)
        for i, q in enumerate(qs)})
    n = len(names)
    ends = staged.filter(F.col("_j") == F.lit(B - 1)).select(
        key, "_blk", *[F.col(f"_loc{i}").alias(f"_e{i}") for i in range(n)])
    # block b feeds block b+1 with weight 1 and block b+2 with weight q^B
    fed = ends.select(key, F.explode(F.array(F.lit(1), F.lit(2))).alias("_d"),
                      "_blk", *[f"_e{i}" for i in range(n)])
    carry = (fed.groupBy(key, (F.col("_blk") + F.col("_d")).alias("_blk"))
             .agg(*[F.sum(F.when(F.col("_d") == 1, F.col(f"_e{i}"))
                          .otherwise(F.col(f"_e{i}") * F.lit(qs[i] ** B))).alias(f"_k{i}")
                    for i in range(n)]))
    out = staged.join(carry, [key, "_blk"], "left")
    out = out.withColumns({
        name: F.col(f"_loc{i}") +
        F.pow(F.lit(qs[i]), F.col("_j") + 1) * F.coalesce(F.col(f"_k{i}"), F.lit(0.0))
        for i, name in enumerate(names)})
    drop = ["_blk", "_j"] + [f"_{p}{i}" for p in ("c", "loc", "k") for i in range(n)]
    return out.drop(*drop)
