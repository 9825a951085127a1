"""A corpus from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``;
the last returns the pieces of the packed sequences. ``run`` writes each stage's rows and reads them again, so that a
lost executor costs a retry of the stage and not of all before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id
from tessera.llm.line_dedup import clean_lines
from tessera.llm.near_dedup import near_dedup
from tessera.llm.packing import pack
from tessera.llm.q_tokens import vocabulary
from tessera.llm.quality_rules import keep_good
from tessera.llm.scratch import Scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't in a language of the corpus go, by the model's score and by its comparison with uniform pieces; a null lang is filled."""
    return language_id.keep_known(docs, language_id.fit(docs, vocabulary("piece_bpe_32k.model")))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or are far from every language's references, go."""
    return keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller doc_id holds too go from the texts."""
    return clean_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with similarity 0.8 or more on five-word shingles the smallest doc_id stays."""
    gone = near_dedup(docs, width=5, min_pct=80).filter("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: Language models, distances and packing aren't expressible in SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        scratch.drop(before)
        before = docs
    return docs
