"""Queries that judge single texts: language and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, licences
from tessera.llm.q_tokens import vocabulary
from tessera.llm.quality_classifier import quality_classifier
from tessera.llm.quality_rules import quality_rules


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs.filter(~language_id.held_out()), vocabulary("piece_bpe_32k.model"))
    return language_id.predict(docs, model, "doc_id", "text", language_id.held_out().alias("held_out"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources; the documents of a source in one language are a path on it."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier(docs, labels, F.col("source"), F.col("lang"))


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = F.array_join(F.array_sort(F.array_distinct("found.family")), ",")
    return out.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_found"), names.alias("families"), F.transform("found", lambda x: x["line"]).alias("lines"))


QUERIES = {"op2_language_id": op2_language_id, "op3_quality_rules": op3_quality_rules, "op6_quality_classifier": op6_quality_classifier, "op8_licence_scan": op8_licence_scan}
SQL: dict[str, str] = {}
