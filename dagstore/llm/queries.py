"""Registered queries of the ten operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagstore.llm import decontaminate, dedup, html_extract, langid, media, packing, quality, secrets, toolcalls, toxicity
from dagstore.llm.runtime import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toolcalls.records(table(spark, sf_dir, "conversations"))
    return toolcalls.link(found, {"reply": toolcalls.REPLY_SCHEMA})


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", items, "contaminated")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicate(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_payloads(table(spark, sf_dir, "documents"), keep=False)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 4) == 2
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", ~held)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 5) == 0
    found = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", ~held)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    found = langid.identify(docs, docs.filter(~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "distance")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_tool_call_linking": op1_tool_call_linking,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_secret_scans": op5_secret_scans,
    "op6_media_columns": op6_media_columns,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_toxicity": op8_toxicity,
    "op9_html_extraction": op9_html_extraction,
    "op10_language_id": op10_language_id,
}

ORACLES: dict[str, str] = {
    "op1_tool_call_linking": toolcalls.DIALOGUE_SQL,
}
