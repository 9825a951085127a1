"""Queries for token counts and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import piece_codec
from tessera.llm.packing import pack
from tessera.llm.token_counts import token_counts


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("piece_bpe_32k.model"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("word_bpe_49k.json"))


QUERIES = {"op7_pack_sequences": op7_pack_sequences, "op9_piece_codec": op9_piece_codec, "op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}
