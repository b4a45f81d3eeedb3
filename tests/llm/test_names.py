"""Carried columns with the names of an operator's own working columns: no crash, the same results, values kept."""

from __future__ import annotations

import importlib
import inspect
import re

import pytest
from pyspark.sql import functions as F

from panelwise.llm import bpe, byte_pieces, common, context_tree, neardup, packing, quality, sharding, substrings, token_counts

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen".split()
DOCS = [
    (i, None if i == 3 else " ".join(WORDS[(i * 7 + k) % 17] for k in range(60 + i)), "en", ["a", "b"][i % 2], 1)
    for i in range(12)
]


def working_names(module) -> list[str]:
    """Every word that the module's source, or its helpers', uses as a column name, and some that nothing uses."""
    sources = [inspect.getsource(m) for m in (module, common, *[importlib.import_module(f"panelwise.llm.{n}") for n in ("components", "suffixes")])]
    found = set()
    for source in sources:
        found |= set(re.findall(r'(?:alias|withColumn|withColumnRenamed|drop|col)\("(\w+)"', source))
        found |= set(re.findall(r"[\"' ,](\w+) (?:long|int|string|binary|double|boolean|array)\b", source))
        found |= set(re.findall(r'names=\[(?:"(\w+)"[, ]*)+', source))
    return sorted({n.lower() for n in found | {"carried_0", "a b", "content", "_text", "center", "row", "_data", "_id", "_n", "_ids", "_start", "_group"}}
                  - common.PLAIN_NAMES)


OPERATORS = {
    "token_counts": (token_counts, lambda d, p: token_counts.count_tokens(d, f"{p}/cache")),
    "encode": (bpe, lambda d, p: bpe.encode(d)),
    "bpe": (bpe, lambda d, p: bpe.round_trip(d)),
    "quality": (quality, lambda d, p: quality.judge(d)),
    "repeats": (substrings, lambda d, p: substrings.remove_repeats(d, length=160)),
    "groups": (neardup, lambda d, p: neardup.find_groups(d)),
    "packing": (packing, lambda d, p: packing.pack(d, length=128)),
    "score": (context_tree, lambda d, p: context_tree.score(d, held_out=F.col("doc_id") % 3 == 2)),
    "shards": (sharding, lambda d, p: sharding.assign_shards(d)),
    "pieces": (byte_pieces, lambda d, p: byte_pieces.round_trip(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_any_column_names(spark, tmp_path, name):
    module, operator = OPERATORS[name]
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars int")
    names = working_names(module)
    crowded = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    plain = operator(docs, tmp_path / "plain")
    got = operator(crowded, tmp_path / "crowded")
    made = [c for c in plain.columns if c not in docs.columns]
    assert len(set(map(str.lower, got.columns))) == len(got.columns)
    key = lambda r: [str(r[c]) for c in ("doc_id", *made)]
    left, right = (sorted(f.collect(), key=key) for f in (plain, got))
    assert [key(r) for r in left] == [key(r) for r in right]
    lower = {c.lower() for c in made}
    for n in names:
        if n not in lower:
            assert n in got.columns, n
            assert all(r[n] == f"{n} {r['doc_id']}" for r in right)


def test_kept_columns_only(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars int")
    odd = docs.withColumn("_text", F.lit("x")).withColumn("row", F.lit(1))
    assert bpe.encode(odd, keep=["row"]).columns == ["row", "ids"]
    assert bpe.encode(odd, text="_text", keep=["doc_id", "_text"]).filter(F.col("_text") == "x").count() == len(DOCS)
