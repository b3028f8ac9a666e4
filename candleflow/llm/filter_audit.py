"""Filter interaction audit (operator 11): what every order of a set of
document filters keeps, removes and loses, and each filter's Shapley share.

Failures
    Every document gets a bit mask of the filters it fails
    (:func:`with_failures`: A to D from the text alone, in one Arrow pass that
    sends back the mask and a SHA-256 of the text; E, an identical text under
    a smaller id anywhere in the table, from the smallest id of each digest).

Coalitions
    ``coalition_counts`` adds the documents up by part and mask: at most 32
    rows a part however large the table.  A coalition S of filters removes
    the documents whose mask meets S, so all 32 coalition values of a part
    follow from those rows.

Shapley by exact constrained least squares
    The values phi minimise the kernel-weighted squares of
    ``v(S) - sum(phi_i, i in S)`` over the coalitions that are neither empty
    nor complete, with weights (n-1) / (C(n,s) s (n-s)), under
    ``sum(phi) = v(all)``.  :func:`shapley` eliminates the constraint's
    multiplier and solves the normal equations in rationals, so ``n! * phi`` is
    an exact integer: the documents a filter removes, summed over all orders.

Steps
    In an order with filters P before f, step counts are differences of
    coalition values: removed = v(P + f) - v(P), kept = v() - v(P + f),
    redundant = v(f) - removed, and unique_fails = v(all) - v(all but f).

Memory and skew: nothing but counts leaves the text pass; digests and ids are
grouped with map-side sums, so a text that makes up a third of the table is
one row a task; ids are joined after repeated (id, text) rows are added up.

Defined cases: a null text is the empty text; a null part is ''; a document
with a null id is never a copy, and no smaller id of another; rows that repeat
an id and a text are separate documents, none a copy of the other; an id
labelled more than once counts as labelled 1 if any of its labels is 1; an
empty table has no parts and gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import as_bytes, bounded_batches

LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 3
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
FLAGS = ("good", "toxic")


def text_mask(text: bytes, n_chars: int) -> int:
    """Bits 0 to 3: the filters A to D that the text fails."""
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER))
    return (len(words) < MIN_WORDS) \
        | (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words)) << 1 \
        | (100 * upper > MAX_UPPER_PERCENT * n_chars) << 2 \
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3


def text_failures(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                  part: str | None = "lang") -> DataFrame:
    """``id``, ``part``, ``digest`` (of the text) and ``mask`` (A to D) of
    every row; the texts go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in batches:
            texts = as_bytes(batch.column("t"))
            chars = [len(t) if t.isascii() else len(t.decode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("part"), pa.array([sha256(t).digest() for t in texts], pa.binary()),
                 pa.array([text_mask(t, n) for t, n in zip(texts, chars)], pa.int32())],
                ["id", "part", "digest", "mask"])

    kind = docs.schema[id_col].dataType.simpleString()
    name = F.coalesce(F.col(part).cast("string"), F.lit("")) if part else F.lit("")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), name.alias("part"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, part string, digest binary, mask int")


def with_failures(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                  part: str | None = "lang") -> DataFrame:
    """``id``, ``part``, ``mask`` (A to E) and ``n``: rows of one id, part
    and text, added up."""
    rows = materialize(text_failures(docs, id_col, text, part)
                       .groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")), "failures")
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("_first"))
    known = rows.where("id is not null").join(
        first.withColumnRenamed("digest", "_d"), (F.col("digest") == F.col("_d")) & (F.col("id") == F.col("_first")),
        "left")
    copy = F.when(F.col("_first").isNull(), F.lit(1 << 4)).otherwise(F.lit(0))
    return known.select("id", "part", F.col("mask").bitwiseOR(copy).alias("mask"), "n").unionByName(
        rows.where("id is null").select("id", "part", "mask", "n"))


def coalition_counts(failures: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                     good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """One row for each part and mask: ``n``, ``good`` and ``toxic``."""
    flags = labels.where(F.col(id_col).isNotNull() & ((F.col(good) == 1) | (F.col(toxic) == 1))) \
        .groupBy(F.col(id_col).alias("id")) \
        .agg(F.max(F.when(F.col(good) == 1, 1).otherwise(0)).alias("_good"),
             F.max(F.when(F.col(toxic) == 1, 1).otherwise(0)).alias("_toxic"))
    known = failures.where("id is not null").join(flags, "id", "left")
    blank = failures.where("id is null").withColumns({"_good": F.lit(0), "_toxic": F.lit(0)})
    return known.unionByName(blank).groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("_good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("_toxic", F.lit(0))).alias("toxic"))


def coalition_values(by_mask: list[int], n: int) -> list[int]:
    """v(S) for every coalition: what is removed by the filters of S."""
    total = sum(by_mask)
    inside = list(by_mask)  # documents whose mask lies inside the coalition
    for i in range(n):
        for s in range(1 << n):
            if s >> i & 1:
                inside[s] += inside[s ^ 1 << i]
    everything = (1 << n) - 1
    return [total - inside[everything ^ s] for s in range(1 << n)]


def _solve(a: list[list[Fraction]], b: list[Fraction]) -> list[Fraction]:
    """Gauss-Jordan elimination in rationals."""
    n = len(b)
    rows = [[*a[i], b[i]] for i in range(n)]
    for c in range(n):
        p = next(r for r in range(c, n) if rows[r][c])
        rows[c], rows[p] = rows[p], rows[c]
        rows[c] = [x / rows[c][c] for x in rows[c]]
        for r in range(n):
            if r != c and rows[r][c]:
                rows[r] = [x - rows[r][c] * y for x, y in zip(rows[r], rows[c])]
    return [r[n] for r in rows]


def shapley(values: list[int], n: int) -> list[Fraction]:
    """The minimiser of the kernel-weighted squares under efficiency."""
    everything = (1 << n) - 1
    if n == 1:
        return [Fraction(values[1] - values[0])]
    a = [[Fraction(0)] * n for _ in range(n)]
    b = [Fraction(0)] * n
    for s in range(1, everything):
        size = s.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        own = [i for i in range(n) if s >> i & 1]
        for i in own:
            b[i] += weight * (values[s] - values[0])
            for j in own:
                a[i][j] += weight
    # a phi + lambda = b and sum(phi) = v(all): phi = free - lambda * ones
    free, ones = _solve(a, b), _solve(a, [Fraction(1)] * n)
    multiplier = (sum(free) - (values[everything] - values[0])) / sum(ones)
    return [x - multiplier * y for x, y in zip(free, ones)]


def audit_part(part: str, counts: dict[str, list[int]], letters: str = LETTERS) -> dict[str, list]:
    """All orders and steps of one part, as columns; ``counts``: documents by
    mask for ``n`` and every flag."""
    n = len(letters)
    v = {k: coalition_values(c, n) for k, c in counts.items()}
    total, everything, orders = sum(counts["n"]), (1 << n) - 1, factorial(n)
    share = [int(x * orders) for x in shapley(v["n"], n)]
    out: dict[str, list] = {k: [] for k in ("part", "filter_order", "step", "kept", "removed", "redundant",
                                            "unique_fails", *[f"{f}_lost" for f in FLAGS], "shapley")}
    for order in permutations(range(n)):
        name, before = "".join(letters[i] for i in order), 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = v["n"][after] - v["n"][before]
            row = (part, name, step, total - v["n"][after], removed, v["n"][1 << f] - removed,
                   v["n"][everything] - v["n"][everything ^ 1 << f],
                   *[v[k][after] - v[k][before] for k in FLAGS], share[f])
            for column, value in zip(out.values(), row):
                column.append(value)
            before = after
    return out


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Every part, order and step of the filters, from ``coalition_counts``."""
    names = ("n", *FLAGS)
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *names)).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                table = {k: [0] * (1 << len(letters)) for k in names}
                for m in r["masks"]:
                    for k in names:
                        table[k][m["mask"]] += m[k]
                out = audit_part(r["part"], table, letters)
                arrays = [pa.array(c, pa.string() if k in ("part", "filter_order") else
                                   pa.int32() if k == "step" else pa.int64()) for k, c in out.items()]
                yield pa.RecordBatch.from_arrays(arrays, list(out))

    lost = ", ".join(f"{f}_lost long" for f in FLAGS)
    return by_part.mapInArrow(run, "part string, filter_order string, step int, kept long, removed long, "
                                   f"redundant long, unique_fails long, {lost}, shapley long")


def audit_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
                    part: str | None = "lang") -> DataFrame:
    """The audit of the five filters over whole texts."""
    return audit(coalition_counts(with_failures(docs, id_col, text, part), labels, id_col))
