"""Small helpers shared by the operators of this package.

A *word* is a maximal run of characters other than space and ``\\x09-\\x0D``.
On UTF-8 bytes that is exactly what ``bytes.split()`` returns, and
``bytes.lower()`` lower-cases exactly A-Z, so Python kernels work on bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Java / RE2 pattern of one word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows sent to a Python worker at once: bounds a worker's memory.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of at most ``rows`` rows (long texts make rows large).

    The setting is the session's and is read when a query runs, after the
    operator has returned its lazy frame, so it stays lowered for later queries
    of the session; their results are the same.  Bytes of a batch are bounded
    by Spark's own ``spark.sql.execution.arrow.maxBytesPerBatch``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (never a local one)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: keys that may be called hot: each holds more than one in so many rows
HOT_KEYS = 50_000


def join_hot(rows: DataFrame, side: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``side`` (one row per ``key``, of which
    ``count`` tells how many of ``total`` rows hold it).

    Keys of more than ``total / HOT_KEYS`` rows, of which there are at most
    ``HOT_KEYS``, are broadcast, so their rows stay where they are; the rows of
    all others, few for each key, meet by a shuffle."""
    hot = F.col(count) > F.lit(max(1000, total // HOT_KEYS))
    frequent = side.where(hot).drop(count)
    rest = side.where(~hot).drop(count)
    here = rows.join(F.broadcast(frequent), key)
    others = rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(rest, key)
    return here.unionByName(others)


def id_fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % F.lit(folds)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def no_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def as_bytes(array) -> list[bytes]:
    """UTF-8 bytes of an Arrow string array; null counts as the empty text."""
    import pyarrow as pa

    return [b or b"" for b in array.cast(pa.binary()).to_pylist()]
