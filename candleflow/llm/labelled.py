"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import no_null


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int,
                    id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``per_class`` labelled rows of each class: ``t`` (text), ``y``
    (0/1), ``u`` (a number in [0, 1) from the id alone).

    ``usable`` is a condition on ``labels``.  The rows with the smallest id
    hash are taken, so the sample is the same in every run, and it is chosen
    among the labels alone: only its ids travel to the documents.  Labels
    that are null or not 0/1, and null ids, are not used; an id labelled
    twice with different labels counts once for each.  Of the documents that
    share a chosen id one is taken, that of the smallest text hash, so the
    sample has at most ``per_class`` rows of a class however often ids repeat.
    """
    rows = labels.where(usable & F.col(id_col).isNotNull() & F.col(label).isin(0, 1)) \
                 .select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y")).distinct() \
                 .withColumn("_h", F.xxhash64("_id", F.lit(5)))
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("y") == y).orderBy("_h", "_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # at most 2 * per_class ids: a bounded broadcast
    found = docs.select(F.col(id_col).alias("_id"), no_null(F.col(text)).alias("t")) \
                .join(F.broadcast(chosen), "_id") \
                .groupBy("_id", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t")) \
                .select("t", "y", (F.pmod(F.xxhash64("_id", F.lit(9)), F.lit(1 << 20)) / (1 << 20)).alias("u"))
    return materialize(found, "labelled")
