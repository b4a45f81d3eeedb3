"""The corpus pipeline: quality rules, near duplicates, repeated strings, packing; each stage on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import neardup, packing, quality, substrings
from panelwise.llm.common import once, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no robust outliers in their language and source."""
    return quality.judge(docs).filter("kept").select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    return neardup.find_groups(docs, percent=80).filter("kept and not repeated").select(*_columns(docs))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of 400 bytes that occur elsewhere, cut at whole characters; emptied documents go.

    ``n_chars``, where there is such a column, counts the characters that are left.
    """
    cleaned = substrings.remove_repeats(docs, whole_characters=True).filter("n_removed < n_bytes or n_bytes = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept_bytes").cast("string")).otherwise(F.col("text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast(kind)).otherwise(F.col("n_chars"))
    return cleaned.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids."""
    return packing.pack(docs, keep=["doc_id"])


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("pack_sequences", pack_sequences),
]

#: Robust estimates, components, suffix order and byte-pair encoding have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = once(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
