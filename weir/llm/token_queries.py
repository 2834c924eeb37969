"""Queries of the tokenizer operators. Their results have no SQL form; tests hold them against the library."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..plans.tables import table
from .bpe import round_trip
from .packing import packed, with_crc32
from .registry import query
from .token_counts import length_histogram, with_suffix_sums
from .token_ids import token_files


@query("op5_token_files")
def op5(spark: SparkSession, d: str) -> DataFrame:
    rows = token_files(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return rows.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op7_token_counts")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return with_suffix_sums(length_histogram(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op8_bpe_round_trip")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return round_trip(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_pack_powers")
def op11(spark: SparkSession, d: str) -> DataFrame:
    return with_crc32(packed(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
