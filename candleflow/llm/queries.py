"""The registered query of each operator: thin, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (brown_lm, embed_dedup, filter_audit, mixing, pii, quality_rules, quality_zstd, simhash_bk,
               spm_codec, token_counts, token_orc, toxicity, whitening)
from .common import id_fold, table
from .labelled import labelled_sample


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Learned from labels whose fold of 4 is not 2."""
    usable = id_fold(F.col("doc_id"), 4) != 2
    return quality_zstd.fit_quality(labelled_sample(
        docs, table(spark, sf_dir, "labels"), "quality", usable, quality_zstd.PER_CLASS))


def toxic_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """Learned from labels whose fold of 5 is not 0."""
    usable = id_fold(F.col("doc_id"), 5) != 0
    return toxicity.fit_toxic(labelled_sample(
        docs, table(spark, sf_dir, "labels"), "toxic", usable, toxicity.PER_CLASS))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality_zstd.with_quality(docs, quality_model(spark, docs, sf_dir))
    return rows.select("doc_id", (id_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                       (F.col("score") >= quality_zstd.THRESHOLD).cast("int").alias("predicted"))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = brown_lm.score_documents(table(spark, sf_dir, "documents"))
    return rows.withColumnRenamed("id", "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.with_toxicity(docs, toxic_model(spark, docs, sf_dir))
    return rows.select("doc_id", (id_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                       (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = embed_dedup.link_embeddings(table(spark, sf_dir, "embeddings"))
    return rows.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
                       F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spm_codec.with_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size("coded.ids").cast("long").alias("n_ids"), "coded.ids",
                       "coded.n_decoded", F.col("coded.same").alias("round_trip"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = pii.with_spans(docs, pii.fit_pii(docs))
    base = F.col("base_spans")

    def count(kind: str):
        code = pii.KINDS.index(kind)
        return F.size(F.filter(base, lambda x: x["kind"] == code)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(pii.spans_text(base), 256).alias("base_sha256"),
                       pii.spans_text(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = quality_rules.with_verdict(docs.select("doc_id", "text", "lang"), quality_rules.fit_reference(docs))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       "base_failed", "kept", F.round("char_distance", 6).alias("char_distance"),
                       F.round("word_distance", 6).alias("word_distance"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"),
                       F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                       F.col("component").alias("component_id"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.with_token_count(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_tokens")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_orc.write_tokens(table(spark, sf_dir, "documents"))
    return token_orc.with_crc32(token_orc.read_tokens(spark, path)).drop("ids")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))
    return rows.select(F.col("id").alias("vec_id"), "component", "n", F.col("deviation").cast("long").alias("deviation"),
                       "whitened", "explained", "identity_error")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_language_model": op2_language_model,
    "op3_toxicity": op3_toxicity,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_mixing": op5_mixing,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_pii": op7_pii,
    "op8_quality_rules": op8_quality_rules,
    "op9_simhash": op9_simhash,
    "op10_token_counts": op10_token_counts,
    "op11_filter_audit": op11_filter_audit,
    "op12_token_orc": op12_token_orc,
    "op13_whitening": op13_whitening,
}
