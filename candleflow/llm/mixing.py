"""Mixing sources to target weights by Sainte-Lague apportionment (operator 5).

Targets
    Sources in code point order (null last) weigh ``weights`` in turn and
    share the words of all documents.  A target stops at ``max_repeats``
    times its source's words; the excess goes to the others by weight until
    no target is above.

Quotas
    Documents of a source are dealt to shards by a seeded hash of id, size and
    text (about ``shard_words`` words each, so a source of any size, and an id
    that many rows share, is spread).  Every shard of every source is a party
    whose votes are its share of its source's target, and ``words // block``
    equal blocks are the seats, given one by one to the highest of the quotients
    votes/1, votes/3, votes/5 ... (:func:`highest_quotients` finds the divisor at
    which they run out by aggregates over the parties, and settles what is
    left at that divisor by quotient, then by party).  What a source's blocks
    differ from its target, less than a block and a half for a source of one
    shard, is made up by a cut block, spread over its shards word by word.

Selection
    Inside a shard documents stand in seeded order.  A quota of more words
    than the shard has is met by whole passes over it; the rest by blocks of
    ``block_words`` words in seeded order, the last one cut at the quota.  No word is taken more than
    ``max_repeats`` times.

Defined cases: null text has size 0; documents of size 0 take nothing and
keep their row (the stage drops them); a null source is a source; repeated
rows are separate documents; rows that share an id (or a null id) are told
apart by size and text, and those that share all three are alike; with no words
at all every target is 0; other columns never enter.  Reruns give the same
result: order is by hash, id, size and text only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import WORD, cut

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK_WORDS = 64
SHARD_WORDS = 1_000_000
SEED = 17
#: rows of a table that is broadcast; divisors looked at in a round; quotients
#: that are settled by sorting
MANY, GRID, FEW = 100_000, 32, 10_000


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``(source, size)`` rows -> one row per source: ``source``,
    ``source_size``, ``weight``, ``target``.  The level at which targets stop
    is found by rounds of one aggregate; sources are never collected."""
    spark = sizes.sparkSession
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = total.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex() \
        .map(lambda r: (r[0][0], r[0][1], weights[r[1] % len(weights)]))
    src = spark.createDataFrame(ranked, T.StructType([
        T.StructField("source", sizes.schema["source"].dataType), T.StructField("source_size", T.LongType()),
        T.StructField("weight", T.IntegerType())]))
    src = cut(src)
    cap = F.col("source_size") * float(max_repeats)
    everything = float(src.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        n, held, free = src.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)),
                                F.sum(F.when(~over, F.col("weight")))).first()
        if n == stopped or not free:
            break
        stopped, level = n, (everything - (held or 0.0)) / free
    return src.withColumn("target", F.least(cap, F.col("weight") * F.lit(float(level or 0.0))))


def _choose(sizes, quota: int, block: int, seed: int):
    """Selection in one shard: ``sizes`` in order -> whole passes, and for
    every document the chosen word ranges of the last, partial pass."""
    import numpy as np

    total = int(sizes.sum())
    passes, rest = divmod(quota, total) if total else (0, 0)
    ends = np.cumsum(sizes)
    cover = np.zeros(-(-total // block), np.int64)  # words taken from the start of each block
    full = np.minimum(block, total - np.arange(len(cover)) * block)
    order = np.random.Generator(np.random.PCG64(seed)).permutation(len(cover))
    upto = np.cumsum(full[order])
    n = int(np.searchsorted(upto, rest))
    cover[order[:n]] = full[order[:n]]
    if n < len(order):
        cover[order[n]] = rest - (upto[n - 1] if n else 0)
    ranges = [[] for _ in range(len(sizes))]
    for b in np.flatnonzero(cover).tolist():
        lo, hi = b * block, b * block + int(cover[b])
        d = int(np.searchsorted(ends, lo, side="right"))
        while lo < hi:
            start, stop = int(ends[d] - sizes[d]), min(hi, int(ends[d]))
            if stop > lo:
                own = ranges[d]
                if own and own[-1][1] == lo - start:
                    own[-1] = (own[-1][0], stop - start)
                else:
                    own.append((lo - start, stop - start))
                lo = stop
            d += 1
    return passes, ranges


def highest_quotients(parties: DataFrame, seats: int, keys: list[str], votes: str = "votes") -> DataFrame:
    """``parties`` with ``seats``: how many of that many seats each gets when
    they go one by one to the highest quotient votes / (2 n + 1), n being the
    party's seats so far; of equal quotients the smaller key is first.

    Party tables are not collected.  A round of one aggregate counts the
    quotients above ``GRID`` divisors, and the interval that the last seat
    falls in is looked at again, until few quotients are left in it.
    """
    some = parties.where(F.col(votes) > 0)
    n, total, most = some.agg(F.count("*"), F.sum(votes), F.max(votes)).first()
    if not n or seats <= 0:
        return parties.withColumn("seats", F.lit(0).cast("long"))

    def above(q) -> F.Column:  # quotients of a party that are at least q
        return F.floor((F.col(votes) / q + 1) / 2).cast("long")

    low, high = total / (2.0 * seats + n), float(most) * 2  # all seats and more are above low, none above high
    n_low, n_high = None, 0
    while n_low is None or n_low - n_high > FEW and high > low * (1 + 1e-15):
        ratio = (high / low) ** (1 / GRID)
        grid = [low, *(low * ratio ** i for i in range(1, GRID)), high]
        counts = list(some.agg(*[F.sum(above(F.lit(q))).alias(f"q{i}") for i, q in enumerate(grid)]).first())
        at = max(i for i, c in enumerate(counts) if i == 0 or c >= seats)
        before = (low, high)
        low, n_low = grid[at], counts[at]
        if at < GRID:
            high, n_high = grid[at + 1], counts[at + 1]
        if (low, high) == before:
            break
    sure = parties.withColumn("_sure", F.when(F.col(votes) > 0, above(F.lit(high))).otherwise(0).cast("long"))
    open_ = sure.where(F.col(votes) > 0).withColumn("_n", F.explode(F.sequence(
        F.col("_sure") + 1, F.greatest(above(F.lit(low)), F.col("_sure") + 1))))
    last = open_.withColumn("_q", F.col(votes) / (2 * F.col("_n") - 1)).where(F.col("_q") >= F.lit(low * (1 - 1e-12))) \
        .orderBy(F.desc("_q"), *[F.col(k).asc_nulls_last() for k in keys], "_n").limit(max(0, seats - n_high))
    more = last.groupBy(*keys).agg(F.count("*").alias("_more"))
    named = [F.col(k).alias(f"_k_{k}") for k in keys]
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = one if same is None else same & one
    return sure.join(more.select(*named, "_more"), same, "left") \
        .withColumn("seats", F.col("_sure") + F.coalesce("_more", F.lit(0))) \
        .drop("_sure", "_more", *[f"_k_{k}" for k in keys])


def shard_quotas(sizes: DataFrame, block: int) -> DataFrame:
    """``_source``, ``_shard`` and ``_quota`` (words) from rows with
    ``_source``, ``_shard``, ``_size``, ``source_size``, ``target``, ``_shards``."""
    parties = sizes.where("_size > 0").groupBy("_source", "_shard").agg(
        F.sum("_size").alias("_words"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.first("_shards").alias("_shards"))
    parties = cut(parties.withColumn("votes", F.col("target") * F.col("_words") / F.col("source_size")))
    words = parties.agg(F.sum("_words")).first()[0] or 0
    seated = cut(highest_quotients(parties, int(words) // block, ["_source", "_shard"]))
    given = seated.groupBy(F.col("_source").alias("_s")).agg(
        (F.round(F.first("target")) - block * F.sum("seats")).cast("long").alias("_rest"))
    rows = seated.join(F.broadcast(given) if given.limit(MANY + 1).count() <= MANY else given,
                       F.col("_source").eqNullSafe(F.col("_s")))

    def upto(k) -> F.Column:
        return F.floor(F.col("_rest") * k / F.col("_shards")).cast("long")

    own = upto(F.col("_shard") + 1) - upto(F.col("_shard"))
    return rows.select("_source", "_shard", (F.col("seats") * block + own).alias("_quota"))


def _with_shards(rows: DataFrame, src: DataFrame, shard_words: int, seed: int) -> DataFrame:
    """Adds ``source_size``, ``target``, ``_shards``, ``_shard`` and ``_order`` to
    rows with ``_source``, ``_id``, ``_size`` and ``_hash`` (of the text); the source
    table is broadcast up to ``MANY`` sources, and joined beyond."""
    src = src.select(F.col("source").alias("_s"), "source_size", "target")
    rows = rows.join(F.broadcast(src) if src.limit(MANY + 1).count() <= MANY else src,
                     F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(shard_words))))
    own = ("_id", "_size", "_hash")
    return rows.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), *own), F.col("_shards")).cast("int")) \
               .withColumn("_order", F.xxhash64(F.lit(seed + 1), *own))


def _with_quotas(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    quotas = quotas.select(F.col("_source").alias("_s"), F.col("_shard").alias("_h"), "_quota")
    side = F.broadcast(quotas) if quotas.limit(MANY + 1).count() <= MANY else quotas
    return rows.join(side, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_h"))).drop("_s", "_h")


def _solve_shard(shard, block: int, seed: int, max_repeats: int):
    """One shard (an Arrow table) in seeded order, its sizes, the number of
    whole passes, and each document's ranges."""
    import numpy as np

    shard = shard.sort_by([(c, "ascending") for c in ("_order", "_id", "_size", "_hash")])
    sizes = shard["_size"].to_numpy().astype(np.int64)
    quota = min(max(0, shard["_quota"][0].as_py()), max_repeats * int(sizes.sum()))
    first = shard["_order"][0].as_py() & 0xFFFFFFFF
    return shard, sizes, *_choose(sizes, quota, block, seed * 1_000_003 + first)


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
             weights=WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK_WORDS,
             shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: ``id``, ``size``, ``source_size``, ``target``,
    ``taken`` (words, repeats counted), ``passes`` (times the whole text is
    taken) and ``ranges`` (word ranges taken once more)."""
    sizes = materialize(docs.select(
        F.col(id_col).alias("_id"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"),
        F.xxhash64(text).alias("_hash")), "sizes")
    src = source_targets(sizes.select(F.col("_source").alias("source"), F.col("_size").alias("size")),
                         weights, max_repeats)
    rows = _with_shards(sizes, src, shard_words, seed)
    quotas = shard_quotas(rows, block)
    id_type = docs.schema[id_col].dataType.simpleString()

    def solve(shard: pa.Table) -> pa.Table:
        shard, sizes, passes, ranges = _solve_shard(shard, block, seed, max_repeats)
        taken = [passes * int(n) + sum(b - a for a, b in r) for n, r in zip(sizes, ranges)]
        parts = [[{"start": a, "stop": b} for a, b in r] for r in ranges]
        return pa.table({
            "id": shard["_id"], "size": shard["_size"], "source_size": shard["source_size"],
            "target": shard["target"], "taken": pa.array(taken, pa.int64()),
            "passes": pa.array([passes] * len(sizes), pa.int64()),
            "ranges": pa.array(parts, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))})

    schema = f"id {id_type}, size long, source_size long, target double, taken long, passes long, " \
             "ranges array<struct<start:long,stop:long>>"
    some = _with_quotas(rows.where("_size > 0"), quotas).groupBy("_source", "_shard").applyInArrow(solve, schema)
    none = rows.where("_size = 0").select(
        F.col("_id").alias("id"), F.col("_size").alias("size"), "source_size", "target",
        F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("passes"),
        F.array().cast("array<struct<start:long,stop:long>>").alias("ranges"))
    return some.unionByName(none)


def cut_words(text: str, ranges: list[tuple[int, int]]) -> str:
    """The given word ranges of a text, each as it stands, joined by newlines."""
    import re

    at = [m.span() for m in re.finditer(WORD, text)]
    return "\n".join(text[at[a][0]:at[b - 1][1]] for a, b in ranges)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
                  n_chars: str | None = "n_chars", weights=WEIGHTS, max_repeats: int = MAX_REPEATS,
                  block: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document appears once
    for every whole pass, and once more with the words of its ranges."""
    keep = docs.columns
    named = [F.col(id_col).alias("_id"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size"),
             F.xxhash64(text).alias("_hash")]
    sizes = materialize(docs.select(*named), "sizes")
    src = source_targets(sizes.select(F.col("_source").alias("source"), F.col("_size").alias("size")),
                         weights, max_repeats)
    quotas = shard_quotas(_with_shards(sizes, src, shard_words, seed), block)
    dealt = _with_quotas(_with_shards(docs.select(F.struct("*").alias("_row"), *named), src, shard_words, seed)
                         .where("_size > 0"), quotas)

    def solve(shard: pa.Table) -> pa.Table:
        shard, sizes, passes, ranges = _solve_shard(shard, block, seed, max_repeats)
        rows = pa.table(shard["_row"].combine_chunks().flatten(), names=keep)
        part = pa.array([i for i, r in enumerate(ranges) if r], pa.int64())
        texts = rows[text].take(part).to_pylist()
        texts = [t if ranges[i] == [(0, sizes[i])] else cut_words(t, ranges[i]) for i, t in zip(part.to_pylist(), texts)]
        cut_rows = rows.take(part)
        for name, values in ((text, texts), (n_chars, list(map(len, texts)))):
            if name in keep:
                field = rows.schema.field(name)
                cut_rows = cut_rows.set_column(keep.index(name), field, pa.array(values, field.type))
        return pa.concat_tables([rows] * passes + [cut_rows])

    return dealt.groupBy("_source", "_shard").applyInArrow(solve, docs.schema)
