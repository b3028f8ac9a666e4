"""Connected components by alternating large-star and small-star rounds.

Edges are replaced by edges towards the smallest neighbour until every
component is a star around its smallest vertex.  Each round is two joins of
the edge table with its per-vertex minimum (partial aggregation first, so a
hub is no single task) and ends in a reliable checkpoint; nothing is
collected but one count pair per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")) \
                .select("a", F.least("a", "m").alias("m"))
    seen = both.join(least, "a")
    moved = seen.where("b > a" if large else "b != m").select(F.col("b").alias("x"), "m")
    if not large:
        moved = moved.union(least.select("a", "m"))
    return moved.where("x != m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(a, b)``: every non-minimal vertex ``a``
    with the smallest vertex ``b`` of its component.  Vertices without an
    edge do not appear; self loops, repeated and reversed edges are allowed.
    """
    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"),
                                           F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        facts = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if facts[0] == 0 or tuple(facts) == state:
            return now
        state = tuple(facts)
        now = cut(_star(_star(now, large=True), large=False))
