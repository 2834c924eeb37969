"""A corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, BPE round trip.

Each stage takes all documents that its predecessor kept, and its decisions take effect: rejected documents, repeated
lines, near copies and contaminated documents are gone for the next one. All stages but the last return the columns of
``documents`` with the texts as they now are (n_chars follows the text); the last returns token counts and
digests. A stage's rows are written as Parquet below the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weir.llm.bpe import round_trip
from weir.llm.common import stored
from weir.llm.decontaminate import clean_documents
from weir.llm.jaccard_join import one_of_each
from weir.llm.line_dedup import MOST_EDITS, without_repeats
from weir.llm.quality import good_documents
from weir.plans.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = without_repeats(docs, MOST_EDITS)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: The tokenizer and the signatures have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
