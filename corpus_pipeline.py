"""The corpus pipeline: language ID, near-dedup, decontamination, secret redaction, packing.

Each stage reads what its predecessor kept and returns the columns of documents, the last the packed pieces.

* language_id drops documents without a letter or without likeness to any language learned from the table's own labels:
  farther than labelled texts of that length lie, by their mean and spread;
* near_dedup keeps one document of each group of near copies, the least id (repeated rows of one id: one row); rows
  with a null id can't be named in a group and stay;
* decontamination drops every document that holds a window of any benchmark item: a passage of eight words in a row, or
  the whole of a shorter item (op2's own flag asks for two items; the passages planted in documents come from one);
* secrets replaces every secret's span by a mark;
* packing cuts and places token sequences.

Every stage passes rows with null texts and empty ones through (language_id drops them, as they have no letter), treats
repeated rows and null ids as stated above (rows of the others stand for themselves), keeps extra columns of any name,
and gives an empty table for an empty one.  The written tables between stages are deleted once the next one is written.

ORACLE_SQL is None: profiles, signatures and tokenizers have no SQL form; tests/llm/test_pipeline.py holds each stage's
rows against plain Python on the cases it is for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagstore.llm import decontaminate, dedup, langid, packing, secrets
from dagstore.llm.runtime import discard, drop_rows, fresh, keep_first, materialize
from dagstore.session import scratch

MAX_DISTANCE = 0.9  # share of the largest out-of-place distance that is too far whatever the labelled texts' distances


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs, docs, MAX_DISTANCE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = dedup.deduplicate(docs)
    return keep_first(drop_rows(docs, found.filter("not kept and doc_id is not null").select("doc_id")))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    id_, key = fresh(docs, "id"), fresh(docs, "text_key")
    keyed = docs.select("*", F.xxhash64("text").alias(key))  # a row is known by id and text: others of its id stay
    rows = keyed.select(F.struct("doc_id", key).alias(id_), "text")
    found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), min_items=1, id_col=id_)
    return drop_rows(keyed, found.filter("contaminated").select(f"{id_}.*")).drop(key)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", redact_secrets),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            kept = keep(materialize(stage(spark, docs, sf_dir), "stage"))
        discard(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
