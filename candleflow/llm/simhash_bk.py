"""SimHash near-duplicates by BK-trees (operator 9).

Fingerprints
    Texts are lower-cased (A-Z only), cut into words, and shingled; each
    shingle, space-joined, is hashed with XXH64 (seed 42) over its UTF-8
    bytes.  A fingerprint bit is 1 if it is set in more than half of the
    shingle hashes.  Fewer words than the shingle length: the whole sequence
    is the one shingle; no word (empty or null text): fingerprint zero.

Links
    Two fingerprints link at ``max_bits`` or fewer differing bits.  Equal
    fingerprints are grouped first.  The distinct ones are sharded by
    pigeonhole: of ``max_bits + 2`` bit bands at least two agree, so every
    link meets in a shard keyed by two bands and their values.  In its shard
    each fingerprint queries a BK-tree, whose children are keyed by the
    integer Hamming distance to their parent: only edges within ``max_bits``
    of the query's own distance are followed.  A shard with more than
    ``chunk`` fingerprints is cut into chunks; every pair of chunks is a
    task group of its own (the tree of one, queried by the other), so no
    group is ever gathered whole and none is capped.

    A shard tree is built where its queries are, not broadcast: the trees
    together grow with the corpus.  A shard returns links to the smallest
    member of each locally connected set, never all pairs.

Defined cases: null text counts as empty; a null id never becomes a
component id unless all ids of the component are null; repeated rows yield
repeated result rows; empty input yields an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches, cut, join_hot
from .components import stars

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
CHUNK = 512


def fingerprint(text: bytes, k: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text as a signed long."""
    import numpy as np
    from xxhash import xxh64_intdigest as h

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        v = h(joined, seed)
        return v - (1 << 64) if v >> 63 else v
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:len(words) - k])).tolist()
    stops = (ends[k - 1:] - 1).tolist()
    hashes = np.fromiter([h(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64, len(stops))
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for any length of text
        part = hashes[at:at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_in > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp",
                     k: int = SHINGLE_WORDS) -> DataFrame:
    """Adds the fingerprint (signed long) of ``text`` as column ``out``."""
    @F.arrow_udf("long")
    def fp_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([fingerprint(b, k) for b in as_bytes(a)], pa.int64())

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, fp_of(F.col(text)))


class BKTree:
    """Values under a root; children keyed by Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root = None

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = (value, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            child = node[1].get(d)
            if child is None:
                node[1][d] = (value, {})
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            at, children = todo.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if children:
                todo += [c for e, c in children.items() if d - radius <= e <= d + radius]
        return found


def group_links(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links of one shard as (value, smallest value of its local component).

    ``right`` None: links inside ``left``; else links between the two chunks.
    Values are unsigned.
    """
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p] if parent[p] != p else p
        return x

    tree = BKTree()
    if right is not None:
        for v in left:
            tree.add(v)
    for v in left if right is None else right:
        for u in tree.within(v, radius):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if right is None:
            tree.add(v)
    return [(v, r) for v in list(parent) if (r := root(v)) != v]


def _bands(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of ``max_bits + 2`` bands that cover 64 bits."""
    n = max_bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links ``(a, b)`` that span all links.
    With a column ``least`` (the smallest id of each), ``a`` and ``b`` are
    (has no id, least, fp), so that no join has to bring the ids back."""
    spark = fps.sparkSession
    named = "least" in fps.columns
    keys = []
    for n, ((s, w), (t, x)) in enumerate(combinations(_bands(max_bits), 2)):
        part = lambda shift, width: F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(F.xxhash64(F.lit(n), part(s, w), part(t, x)))
    keyed = fps.select("fp", (F.col("least") if named else F.lit(None).cast("long")).alias("least"),
                       F.explode(F.array(*keys)).alias("k"))
    crowd = keyed.groupBy("k").count().where("count > 1") \
                 .select("k", F.ceil(F.col("count") / F.lit(chunk)).cast("int").alias("n"))
    sides = keyed.join(crowd, "k").select(
        "k", "fp", "least", "n", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int").alias("c"))
    sides = sides.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "k", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "fp", "least")
    dealt = sides.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j", "c", "fp")
    least_type = pa.int64() if not named else None

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << 64) - 1
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        kind = least_type

        def solve(key, by_chunk, ids):
            _, i, j = key
            right = None if i == j else by_chunk.get(j, [])
            return [(v, ids[v], r, ids[r]) for v, r in group_links(by_chunk.get(i, []), right, max_bits)]

        def batch_of(out):
            a, ia, b, ib = zip(*out) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(list(map(signed, a)), pa.int64()), pa.array(ia, kind),
                 pa.array(list(map(signed, b)), pa.int64()), pa.array(ib, kind)], ["a", "ia", "b", "ib"])

        now, members, ids, out = None, {}, {}, []
        for batch in batches:
            kind = batch.schema.field("least").type
            for k, i, j, c, fp, least in zip(*(col.to_pylist() for col in batch.columns)):
                if (k, i, j) != now:
                    if now is not None:
                        out += solve(now, members, ids)
                    now, members, ids = (k, i, j), {}, {}
                members.setdefault(c, []).append(fp & mask)
                ids[fp & mask] = least
            if out:
                yield batch_of(out)
                out = []
        if now is not None:
            out = solve(now, members, ids)
            if out:
                yield batch_of(out)

    bounded_batches(spark, 10_000)
    id_type = keyed.schema["least"].dataType.simpleString()
    found = dealt.mapInArrow(links, f"a long, ia {id_type}, b long, ib {id_type}")
    if not named:
        return found.select("a", "b")
    return found.select(_vertex("a", "ia").alias("a"), _vertex("b", "ib").alias("b"))


def _vertex(fp: str, least: str):
    """Ordered by smallest id, fingerprints without one last."""
    return F.struct(F.col(least).isNull().alias("blank"), F.col(least).alias("least"), F.col(fp).alias("fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fp`` (signed long), ``grp`` (one
    value for each group of linked documents), ``component`` (its smallest id)."""
    marked = cut(with_fingerprint(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")),
                                  "t", "fp", k).select("id", "fp"))
    fps = cut(marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("rows")))
    star = stars(fingerprint_links(fps.select("fp", "least"), max_bits, chunk))
    # the vertices are ordered by id: the centre of a star has the smallest
    star = star.select(F.col("a.fp").alias("fp"), F.col("b.fp").alias("g"), F.col("b.least").alias("c"))
    found = fps.join(star, "fp", "left").select(
        "fp", F.coalesce("g", "fp").alias("grp"),
        F.when(F.col("g").isNull(), F.col("least")).otherwise(F.col("c")).alias("component"), "rows")
    total = fps.agg(F.sum("rows")).first()[0] or 0
    return join_hot(marked, cut(found), "fp", "rows", total).select("id", "fp", "grp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
             k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group stays, with all columns of ``docs``: that of the
    smallest id (of rows with that id, the smallest fingerprint, then text)."""
    marked = near_duplicates(docs, id_col, text, k, max_bits)
    stay = marked.where(F.col("id").eqNullSafe(F.col("component"))) \
                 .groupBy("grp").agg(F.min("fp").alias("_f"), F.min("id").alias("_i")).drop("grp")
    rows = with_fingerprint(docs, text, "_fp", k)
    kept = rows.join(stay, (F.col("_fp") == F.col("_f")) & F.col(id_col).eqNullSafe(F.col("_i")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = F.struct(F.col(text).isNotNull(), F.col(text), F.xxhash64(whole))
    return kept.groupBy("_f", "_i").agg(F.min_by(whole, first).alias("_row")).select("_row.*")
