"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, fingerprints, langid, linededup, mixing, neardup, packing, phrases, resample, rules, sanitise, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_successor(_table(spark, sf_dir, "documents"))


def op2_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.copies(_table(spark, sf_dir, "documents"))
    return mix.select("doc.doc_id", "size", "source_size", "target", "taken", "doc.source", "rate", "copies")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_policy(rules.ledger(_table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.deduplicated(_table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "doc.text", "n_lines", "n_dropped", "is_copy")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(_table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise.findings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_resampling, op3_warc, op4_mixing, op5_toxicity, op6_near_duplicates, op7_rules, op8_line_templates, op9_language, op10_packing,
        op11_phrases, op12_personal_data, op13_centroids,
    )
}
ORACLES: dict[str, str] = {"op7_rules": rules.ORACLE, "op11_phrases": phrases.ORACLE, "op13_centroids": centroids.ORACLE}
