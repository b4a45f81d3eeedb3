"""Shards of nearly equal size that keep equal texts together: longest-processing-time scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import any_names, utf8
from panelwise.operators.ranking import running_totals
from panelwise.session import cut


def longest_first(sizes: dict, shards: int) -> dict:
    """Item to shard: items from the largest down, each to the least loaded shard (ties: name, shard number)."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


@any_names
def assign_shards(
    docs: DataFrame, text: str = "text", shards: int = 8, items: int = 8192, keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) plus ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    A row's size is its text's UTF-8 bytes plus 1 (null text: 1, checksum of no bytes, grouped with empty texts).
    Rows with equal texts form a group and share a shard. The schedule's items are the groups that hold at
    least ``1 / items`` of all bytes, of which there are at most ``items``, and the other groups in ``items``
    bundles by the hash of their text; a bundle is a few groups of small size. So the heap sees at most
    ``2 * items`` items however many rows there are, and shards differ by at most about one bundle.
    ``slot`` numbers the rows of a shard from 0 without gaps. ``law`` is ``bytes``; ``grown_shard`` is null.
    Columns of ``docs`` with these names are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    data = utf8(text)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    sized = cut(docs.select(
        *[F.col(f"`{c}`") for c in kept],
        (F.octet_length(data).cast("long") + 1).alias("size"), F.crc32(data).alias("text_crc32"),
        F.unhex(F.sha2(data, 256)).alias("_group"),
    ))
    groups = cut(
        sized.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    )
    total = groups.agg(F.sum("_bytes")).first()[0] or 0
    large = F.col("_bytes") * items >= F.lit(total)
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("_group"), F.lit(items)).cast("string"))
    named = groups.withColumn("_item", F.when(large, F.hex("_group")).otherwise(bundle))
    # at most 2 * items rows: large groups number at most `items`, and so do bundles
    loads = {r["_item"]: r["_load"] for r in named.groupBy("_item").agg(F.sum("_bytes").alias("_load")).collect()}
    placed = spark.createDataFrame(
        list(longest_first(loads, shards).items()), "_item string, _shard int"
    )
    by_group = named.join(F.broadcast(placed), "_item").select("_group", "_shard")
    # written before the join, so that the adaptive skew join can split a group with very many rows
    by_group = cut(by_group)
    rows = sized.join(by_group, "_group").withColumn("shard", F.col("_shard"))
    rows = rows.withColumn("_key", F.monotonically_increasing_id()).withColumn("_one", F.lit(1).cast("long"))
    placed_rows = running_totals(rows.drop("_group", "_shard"), ["_key"], ["_one"], ["shard"])
    return placed_rows.select(
        *kept, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_one_upto") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
