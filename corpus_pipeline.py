"""A training corpus from ``documents``: each stage works on all rows that the
stage before it kept, and is written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``documents``.  Nulls, repeated rows and empty
tables are handled as the operators say; a stage needs no column to be set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candleflow.llm import mixing, pii, simhash_bk, spm_codec, toxicity
from candleflow.llm.common import table
from candleflow.llm.queries import toxic_model
from candleflow.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go; the lexicon is
    learned from the labels of the documents at hand."""
    scored = toxicity.with_toxicity(docs, toxic_model(spark, docs, sf_dir), out="_toxic")
    return scored.where(F.col("_toxic") < toxicity.THRESHOLD).select(*docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays."""
    return simhash_bk.keep_one(docs, k=simhash_bk.SHINGLE_WORDS, max_bits=simhash_bk.MAX_BITS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; ``n_chars`` follows."""
    rows = pii.with_spans(docs, pii.fit_pii(docs))
    rows = rows.withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    count = F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target shares: whole copies, then chosen word blocks."""
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, next to the columns of ``documents``."""
    return spm_codec.with_ids(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", dedup),
    ("PII", redact),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", tokenize),
]

#: Fitted models, hashing, seeded selection and tokenizing are not SQL; tests
#: use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = materialize(stage(spark, rows, sf_dir), name.split()[0].lower())
    return rows
