"""One query per operator: its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import (
    bwt_dedup, byte_bpe, exact_dedup, imatch, license_scan, packing, quote_linking, simhash, source_audit,
    substring_dedup, suffix_quality, token_alignment, token_files)


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; the operators take it as a parameter."""
    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed",
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.token_file(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(tokenizer_file("byte_bpe_multi_50k.tiktoken"))
    rows = byte_bpe.encode_decode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    return rows.select(F.col("id").alias("doc_id"), "n_tokens",
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imatch.edited_likeness(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256",
                       F.lower(F.hex("own")).alias("fingerprint"),
                       F.lower(F.hex("edited")).alias("edited_fingerprint"), "near_edited", "near_next")


def op4_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bwt_dedup.remove_repeats(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed",
                       F.size("removed").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op5_suffix_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_quality.quality(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"),
                       F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       F.col("component").alias("component_id"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir), named=True).withColumnRenamed("id", "doc_id")


def op8_license_scan_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a notice at its end that is wrapped over lines."""
    docs = license_scan.wrapped(documents(spark, sf_dir))
    return license_scan.scan(docs, named=True).withColumnRenamed("id", "doc_id")


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations, written as replies that quote, are linked and freed of quotes."""
    messages = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return quote_linking.link(quote_linking.as_replies(messages))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))
    return rows.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32",
                       "sequence_id", "offset")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"),
                                 tokenizer_file("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_duplicates(documents(spark, sf_dir), digest=True)
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                       F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_substring_dedup, op2_token_files, op3_imatch, op4_bwt_dedup, op5_suffix_quality, op6_byte_bpe, op7_simhash,
    op8_license_scan, op8_license_scan_wrapped, op9_quote_linking, op10_packing, op11_source_audit, op12_token_alignment,
    op13_exact_dedup)}
ORACLES = {"op8_license_scan": license_scan.oracle(named=True),
           "op8_license_scan_wrapped": license_scan.oracle(source=license_scan.wrapped_sql(), named=True),
           "op9_quote_linking": quote_linking.ORACLE,
           "op11_source_audit": source_audit.ORACLE, "op13_exact_dedup": exact_dedup.ORACLE}
