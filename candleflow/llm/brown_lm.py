"""Language-model scoring by Brown class-based n-grams (operator 2).

Texts are lower-cased (A-Z), cut into words and closed by one end token.

Counts
    Words of the training rows are counted over the whole corpus (each task
    adds up its own first).  A word that makes up at least ``FREQUENT`` of
    the tokens travels to the tasks as part of a table: there can be at most
    ``1 / FREQUENT`` of them.  All other words are met by a join.

Classes
    The things that get classes are *units*: each word with at least
    ``OWN_UNIT`` of the tokens (at most ``1 / OWN_UNIT``), the end token, and
    for all other words, known or not, one of ``ENDINGS`` groups by their
    last three bytes.  Exchange clustering: in each sweep the neighbour
    classes of every unit are counted over the whole training text (a table
    of units by 2 x ``CLASSES`` counts, however large the corpus), and units
    move to the class that raises the likelihood of their left and right
    neighbours most; half of the units may move in a sweep, so that
    neighbours do not swap past each other.  The assignment with the best
    class-bigram likelihood is kept.

Probability
    P(word | class before) = P(class | class before) * P(word | class), with
    P(class | before) = (n(before, class) + KAPPA * P(class)) / (n(before) + KAPPA)
    P(word | class) = (c + DELTA) / (n(class) + DELTA * (types(class) + 1)),
    where the end of the text before stands before the first word.  The base
    model is the unigram (c + DELTA) / (N + DELTA * (V + 1)).  Both need the
    same sum of log10(c + DELTA), so rare words are joined once for both.

Defined cases: null text is the empty text, which is one end token; without
training rows N = V = 0 and all counts are 0; repeated rows are scored (and
counted) each; texts of any length are scored whole; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import as_bytes, bounded_batches, id_fold
from .share import share, shared

FOLDS = 10
FREQUENT = 1e-6
OWN_UNIT = 2e-5
ENDINGS = 1024
CLASSES = 64
SWEEPS = 8
DELTA = 0.1
KAPPA = 20.0
#: distinct words a task counts before it hands them on
FLUSH = 400_000


def _ending(word: bytes) -> int:
    from zlib import crc32

    return crc32(word[-3:]) % ENDINGS


def _ending_column(word: Column) -> Column:
    return (F.crc32(F.substring(word, -3, 3)) % ENDINGS).cast("int")


def count_words(training: DataFrame, text: str) -> DataFrame:
    """``(w binary, c long)`` over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["w", "c"])

        for batch in batches:
            for t in as_bytes(batch.column(0)):
                seen.update(t.lower().split())
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    return training.select(text).mapInArrow(count, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """The frequent words; unit 0 is the end token, then the endings, then
    the words with a unit of their own."""

    index: dict[bytes, int]
    log_count: list[float]
    unit: list[int]
    n_units: int


def encode(docs: DataFrame, words: Words, id_col: str, text: str, held: Column) -> DataFrame:
    """One row per document: its units, what is known of its frequent words,
    and its other words with their numbers."""
    packed = share(docs.sparkSession, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        w = shared(packed)
        get = w.index.get
        logs, own = np.array(w.log_count + [0.0]), np.array(w.unit + [0], np.int32)
        for batch in batches:
            units, sizes, known, sums, rare, times = [], [], [], [], [], []
            for t in as_bytes(batch.column("t")):
                tokens = t.lower().split()
                ids = np.array([get(x, -1) for x in tokens], np.int32)
                u = np.append(own[ids], np.int32(0)) if len(ids) else np.zeros(1, np.int32)
                missing = np.flatnonzero(ids < 0).tolist()
                if missing:
                    u[missing] = [1 + _ending(tokens[i]) for i in missing]
                other = Counter([tokens[i] for i in missing])
                units.append(u)
                sizes.append(len(u))
                known.append(len(ids) - len(missing))
                sums.append(float(logs[ids].sum()) if len(ids) else 0.0)
                rare.append(list(other))
                times.append(list(other.values()))
            offsets = np.concatenate(([0], np.cumsum(sizes))) if sizes else np.zeros(1, int)
            flat = np.concatenate(units) if units else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("id"), batch.column("held"), pa.array(sizes, pa.int64()),
                 pa.array(known, pa.int64()), pa.array(sums, pa.float64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32())),
                 pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))],
                ["rid", "id", "held", "n_tokens", "known", "sum_log", "units", "rare", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"),
                       held.alias("held"), F.col(text).alias("t"))
    return rows.mapInArrow(run, f"rid long, id {kind}, held boolean, n_tokens long, known long, sum_log double, "
                                "units array<int>, rare array<binary>, times array<long>")


def _neighbours(encoded: DataFrame, classes, n_classes: int):
    """Counts of the classes after (first half) and before every unit."""
    import numpy as np

    n_units = len(classes)
    packed = share(encoded.sparkSession, np.asarray(classes, np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, width = shared(packed), 2 * n_classes
        total = np.zeros(n_units * width, np.int64)
        for batch in batches:
            column = batch.column(0)
            u = column.flatten().to_numpy().astype(np.int64)
            if not len(u):
                continue
            # a text begins after an end token, unit 0; it ends with its own
            before = np.empty_like(u)
            before[1:], before[0] = u[:-1], 0
            for pair in (before * width + cls[u], u * width + n_classes + cls[before]):
                if n_units * width < 8 * len(u):
                    total += np.bincount(pair, minlength=len(total))
                else:
                    at, n = np.unique(pair, return_counts=True)
                    total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["k", "n"])

    rows = encoded.where("not held").select("units").mapInArrow(count, "k long, n long") \
                  .groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_units * 2 * n_classes, np.int64)
    out[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(n_units, 2 * n_classes)


def _likelihood(pairs) -> float:
    """Class-bigram part of the log-likelihood."""
    import numpy as np

    left, right = pairs.sum(1, keepdims=True), pairs.sum(0, keepdims=True)
    on = pairs > 0
    return float((pairs[on] * np.log(pairs[on] / (left * right)[on])).sum())


def exchange(encoded: DataFrame, n_units: int, order, n_classes: int = CLASSES, sweeps: int = SWEEPS):
    """Class of every unit (the end token alone in class 0), and the class
    bigram counts.  ``order``: units by frequency, for the first assignment."""
    import numpy as np

    classes = np.zeros(n_units, np.int64)
    classes[order] = 1 + np.arange(len(order)) % (n_classes - 1)
    classes[0] = 0
    turn = np.random.default_rng(3).permutation(n_units) % 2
    best = None
    for sweep in range(sweeps + 1):
        near = _neighbours(encoded, classes, n_classes)
        pairs = np.zeros((n_classes, n_classes))
        np.add.at(pairs, classes, near[:, :n_classes])
        value = _likelihood(pairs)
        if best is None or value > best[0]:
            best = (value, classes.copy(), pairs)
        if sweep == sweeps:
            break
        smooth = pairs + 0.5
        after = np.log(smooth / smooth.sum(1, keepdims=True))  # class -> class after it
        before = np.log(smooth / smooth.sum(0, keepdims=True)).T  # class -> class before it
        gain = near[:, :n_classes] @ after.T + near[:, n_classes:] @ before.T
        gain[:, 0] = -np.inf
        move = (turn == sweep % 2) & (near.sum(1) > 0)
        move[0] = False
        classes[move] = gain[move].argmax(1)
    return best[1], best[2]


@dataclass
class BrownModel:
    words: Words
    classes: list[int]  # of units
    log_next: list[list[float]]  # log10 P(class | class before)
    log_size: list[float]  # log10 of the denominators of P(word | class)
    n: int
    v: int
    ends: int


def fit_and_encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                   folds: int = FOLDS) -> tuple[BrownModel, DataFrame, DataFrame]:
    """The model, all documents encoded, and the rare words' counts."""
    import numpy as np

    bounded_batches(docs.sparkSession)
    held = id_fold(F.col(id_col), folds) == 0
    training = docs.where(~held)
    vocab = materialize(count_words(training, text), "vocabulary")
    ends = training.count()
    n, v = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)

    frequent = vocab.where((F.col("c") >= FREQUENT * n)).orderBy(F.desc("c"), "w").toArrow()
    names, counts = frequent["w"].to_pylist(), frequent["c"].to_pylist()
    n_own = sum(c >= OWN_UNIT * n for c in counts)
    first = 1 + ENDINGS
    unit = [first + i if i < n_own else 1 + _ending(w) for i, w in enumerate(names)]
    words = Words({w: i for i, w in enumerate(names)}, [math.log10(c + DELTA) for c in counts], unit,
                  first + n_own)
    encoded = materialize(encode(docs, words, id_col, text, held), "encoded")

    # types by unit, over the whole vocabulary
    types = np.zeros(words.n_units, np.int64)
    types[0] = ends > 0
    for r in vocab.groupBy(_ending_column(F.col("w")).alias("e")).count().collect():
        types[1 + r["e"]] = r["count"]
    for i in range(n_own):
        types[1 + _ending(names[i])] -= 1
        types[first + i] = 1

    order = np.concatenate([np.arange(first, words.n_units), np.arange(1, first)])
    classes, pairs = exchange(encoded, words.n_units, order, CLASSES, SWEEPS)
    into = pairs.sum(0)
    class_types = np.bincount(classes, weights=types, minlength=len(into))
    prior = (into + DELTA) / (into.sum() + DELTA * len(into))
    nxt = (pairs + KAPPA * prior) / (pairs.sum(1, keepdims=True) + KAPPA)
    model = BrownModel(words, classes.tolist(), np.log10(nxt).tolist(),
                       np.log10(into + DELTA * (class_types + 1)).tolist(), int(n), int(v), ends)
    return model, encoded, vocab.where(F.col("c") < FREQUENT * n)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    folds: int = FOLDS) -> DataFrame:
    """One row per document: ``id``, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score``, ``perplexity`` (per token)."""
    model, encoded, rare = fit_and_encode(docs, id_col, text, folds)
    tables = share(docs.sparkSession, 
        (model.classes, model.log_next, model.log_size))

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        classes, nxt, size = map(np.array, shared(tables))
        step = (nxt - size[None, :]).ravel()
        for batch in batches:
            column = batch.column("units")
            offsets = column.offsets.to_numpy()
            u = column.values.to_numpy()[offsets[0]:offsets[-1]]
            c = classes[u]
            before = np.empty_like(c)
            if len(c):
                before[1:], before[0] = c[:-1], 0
            parts = step[before * len(size) + c]
            sums = np.add.reduceat(parts, offsets[:-1] - offsets[0]) if len(c) else np.zeros(len(column))
            keep = [batch.column(k) for k in ("rid", "id", "held", "n_tokens", "known", "sum_log")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(sums, pa.float64())],
                ["rid", "id", "held", "n_tokens", "known", "sum_log", "class_log"])

    kind = encoded.schema["id"].dataType.simpleString()
    scored = encoded.select("rid", "id", "held", "n_tokens", "known", "sum_log", "units").mapInArrow(
        by_class, f"rid long, id {kind}, held boolean, n_tokens long, known long, sum_log double, class_log double")
    others = encoded.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")) \
        .select("rid", F.col("x.rare").alias("w"), F.col("x.times").alias("k"))
    c = F.coalesce("c", F.lit(0))
    sums = others.join(rare, "w", "left").groupBy("rid").agg(
        F.sum(F.col("k") * F.log10(c + F.lit(DELTA))).alias("rare_log"),
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("rare_known"))
    end_log = math.log10(model.ends + DELTA)
    count_log = F.col("sum_log") + F.coalesce("rare_log", F.lit(0.0)) + F.lit(end_log)
    base = count_log - F.col("n_tokens") * F.lit(math.log10(model.n + DELTA * (model.v + 1)))
    score = count_log + F.col("class_log")
    return scored.join(sums, "rid", "left").select(
        "id", F.col("held").alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(model.ends > 0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
