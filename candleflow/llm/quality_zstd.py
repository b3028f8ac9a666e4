"""Quality by a compression classifier (operator 1).

Two Zstandard dictionaries are built from labelled text, one from good and
one from bad documents.  A document is cut into chunks of ``CHUNK`` bytes and
every chunk is compressed with either dictionary; text that is like the good
sample gets smaller with the good dictionary.  The normalised difference of
the compressed sizes, (bad - good) / (bad + good), over the whole text and at
its worst chunk, together with how far the better dictionary compresses
(repetition) and how long the text is (short texts compress raggedly),
becomes a probability by a logistic calibration fitted on
labelled rows that are in neither dictionary.

``PER_CLASS`` rows of each class are the bounded sample: ``DICT_SHARE`` of
them (by a hash of the id) feed the dictionaries, evenly up to
``DICT_BYTES`` each, the others the calibration.

Defined cases: null and empty texts are one empty chunk and get the score the
calibration gives it; whole texts of any length are scored; without labelled
rows of both classes every score is 0.5; repeated rows score alike; other
columns are kept, a column of the name asked for is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded_batches
from .logistic import fit_logistic, sigmoid
from .share import share, shared

PER_CLASS = 6_000
DICT_SHARE = 0.6
DICT_BYTES = 1 << 20
CHUNK = 2048
LEVEL = 3
THRESHOLD = 0.7
FEATURES = 6


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]


class Scorer:
    """Features and scores with the dictionaries digested once."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        from zstandard import DICT_TYPE_RAWCONTENT, ZstdCompressionDict, ZstdCompressor

        self.compress = []
        for content in (good, bad):
            d = ZstdCompressionDict(content, dict_type=DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compress.append(ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False,
                                                write_checksum=False, write_dict_id=False).compress)

    def features(self, text: bytes) -> list[float]:
        from math import log

        good, bad = self.compress
        sum_good = sum_bad = 0
        worst, least, most, mean = 1.0, 9.0, -9.0, 0.0
        for at in range(0, max(1, len(text)), CHUNK):
            chunk = text[at:at + CHUNK]
            g, b, n = len(good(chunk)), len(bad(chunk)), max(1, len(chunk))
            sum_good, sum_bad = sum_good + g, sum_bad + b
            rate = log(min(g, b) / n)
            worst, least, most = min(worst, (b - g) / (b + g)), min(least, rate), max(most, rate)
            mean += rate * n
        return [(sum_bad - sum_good) / (sum_bad + sum_good), worst, least, mean / max(1, len(text)), most,
                log(len(text) + 1)]


def _terms(features, model_mean, model_scale) -> list[float]:
    """Standardised features, their squares, and what each means at this length."""
    z = [min(6.0, max(-6.0, (f - m) / s)) for f, m, s in zip(features, model_mean, model_scale)]
    return z + [v * v for v in z] + [v * z[-1] for v in z[:-1]]


def fit_quality(sample: DataFrame) -> QualityModel | None:
    """From ``t``, ``y`` (1: good), ``u`` (see :mod:`.labelled`); None if a
    class is missing."""
    import numpy as np

    by_class = {r["y"]: r for r in sample.where(F.col("u") < DICT_SHARE).groupBy("y").agg(
        F.count("*").alias("n")).collect()}
    if len(by_class) < 2:
        return None
    contents = []
    for y in (1, 0):
        # an even share of every document, from its middle: at most DICT_BYTES in all
        share = max(256, DICT_BYTES // by_class[y]["n"] * 2)
        start = F.greatest(F.lit(1), ((F.length("t") - share) / 2).cast("int"))
        rows = sample.where((F.col("u") < DICT_SHARE) & (F.col("y") == y)) \
                     .select("u", F.substring(F.col("t"), start, F.lit(share)).alias("t")) \
                     .orderBy("u", "t").collect()
        contents.append("\n".join(r["t"] for r in rows).encode()[:DICT_BYTES].ljust(8))
    good, bad = contents

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(good, bad)
        for batch in batches:
            rows = [scorer.features(t) for t in as_bytes(batch.column("t"))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    bounded_batches(sample.sparkSession)
    rows = sample.where(F.col("u") >= DICT_SHARE).select("t", "y").mapInArrow(
        measure, "x array<double>, y int").collect()
    rows.sort(key=lambda r: (r["y"], r["x"]))
    x = np.array([r["x"] for r in rows]) if rows else np.zeros((0, FEATURES))
    mean = x.mean(0).tolist() if len(x) else [0.0] * FEATURES
    scale = [float(s) or 1.0 for s in x.std(0)] if len(x) else [1.0] * FEATURES
    weights = fit_logistic([_terms(r, mean, scale) for r in x], [r["y"] for r in rows], prior=[0.0] * (3 * FEATURES))
    return QualityModel(good, bad, mean, scale, weights)


def with_quality(docs: DataFrame, model: QualityModel | None, text: str = "text",
                 out: str = "score") -> DataFrame:
    """Adds ``out``: the probability (0 to 1) that the text is good."""
    if model is None:
        return docs.withColumn(out, F.lit(0.5))
    packed = share(docs.sparkSession, model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared(packed)
        scorer = Scorer(m.good, m.bad)
        w = m.weights
        for a in batches:
            out = []
            for t in as_bytes(a):
                terms = _terms(scorer.features(t), m.mean, m.scale)
                out.append(sigmoid(w[0] + sum(p * q for p, q in zip(w[1:], terms))))
            yield pa.array(out, pa.float64())

    bounded_batches(docs.sparkSession)
    return docs.withColumn(out, score(F.col(text)))
