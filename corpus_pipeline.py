"""The corpus pipeline: quality rules, near-duplicates, repeated passages, packing.

``STAGES`` are applied in order, each to what the one before has kept, written as Parquet
and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import packing, simhash, substring_dedup, suffix_quality
from touchline.llm.queries import tokenizer_file
from touchline.sources.scratch import materialize, temporary_tables


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return suffix_quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return simhash.keep_one(docs)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that an earlier document has go; n_chars follows the text."""
    left = substring_dedup.dedup_texts(docs)
    if "n_chars" in left.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    rows = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))
    return rows.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32",
                       "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("best-fit packing", best_fit_packing),
]

#: Suffix arrays, XXH64 and the tokenizer have no SQL; tests hold run() against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        # Once a stage's result is written, the tables it worked with can go.
        with temporary_tables(spark) as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"pipeline-{number}"))
    return STAGES[-1][1](spark, docs, sf_dir)
