"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import (
    bpe, byte_pieces, context_tree, covertree, divergence, hard_negatives, neardup, packing, quality, sharding, substrings, token_counts, warc,
)
from panelwise.llm.common import table
from panelwise.llm.oracle import ORACLE
from panelwise.session import new_path


def op1_token_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return token_counts.count_tokens(docs, new_path(spark, "token_cache"), keep=["doc_id"])


def op2_bpe_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return bpe.round_trip(table(spark, d, "documents"), keep=["doc_id"])


def op3_quality(spark: SparkSession, d: str) -> DataFrame:
    judged = quality.judge(table(spark, d, "documents"), keep=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_repeated_strings(spark: SparkSession, d: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, d, "documents"), keep=["doc_id"], with_text=False)


def op5_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    found = neardup.find_groups(table(spark, d, "documents"), percent=85, keep=["doc_id"])
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), keep=["doc_id"], with_ids=False)


def op7_context_tree(spark: SparkSession, d: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = context_tree.score(table(spark, d, "documents"), held_out=held_out, keep=["doc_id"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_warc(spark: SparkSession, d: str) -> DataFrame:
    archives, index = new_path(spark, "archives"), new_path(spark, "captures")
    warc.write_archives(table(spark, d, "pages"), archives)
    warc.build_index(spark, archives, index)
    records = warc.read_records(spark, archives, warc.captures(spark, index), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_top_k(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return covertree.top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


def op10_shards(spark: SparkSession, d: str) -> DataFrame:
    return sharding.assign_shards(table(spark, d, "documents"), keep=["doc_id"])


def op11_source_divergence(spark: SparkSession, d: str) -> DataFrame:
    return divergence.audit(table(spark, d, "documents"))


def op12_byte_pieces(spark: SparkSession, d: str) -> DataFrame:
    return byte_pieces.round_trip(table(spark, d, "documents"), keep=["doc_id"])


def op13_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, d, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


__all__ = ["ORACLE", "QUERIES"]

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_quality": op3_quality,
    "op4_repeated_strings": op4_repeated_strings,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_packing": op6_packing,
    "op7_context_tree": op7_context_tree,
    "op8_warc": op8_warc,
    "op9_top_k": op9_top_k,
    "op10_shards": op10_shards,
    "op11_source_divergence": op11_source_divergence,
    "op12_byte_pieces": op12_byte_pieces,
    "op13_hard_negatives": op13_hard_negatives,
}
