"""The registered queries of the corpus operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import bpe, html_text, lang_id, licenses, media, packing, quality_rules, simhash_vp, token_counts, toxicity
from textloom.llm.common import held_out, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = lang_id.learn(docs.where(~held_out()))
    return lang_id.identify(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def toxicity_machine(spark: SparkSession, sf_dir: str) -> toxicity.Machine:
    """Learned from the labelled rows outside fold 0."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.train(*toxicity.sample(table(spark, sf_dir, "documents"), labels))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_machine(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_bpe, op3_html_extraction, op4_language_id, op5_token_counts, op6_best_fit_packing, op7_media_columns, op8_toxicity, op9_simhash_near_dedup, op10_license_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op10_license_scan": licenses.scan_sql()}


