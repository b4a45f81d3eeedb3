"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import once, release


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (the smallest node that can be reached) for every node that has a link.

    Each round turns links towards the smallest neighbour; the number of rounds grows with the logarithm of
    the longest path. Smallest neighbours are partial minima, and they are written before they are joined
    back, so that the join can split a node with very many links. Links to itself and repeated links do not count.
    """
    links = once(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    )
    state = _state(links)
    while True:
        large = _star(links, large=True)
        release(links)
        links = _star(large, large=False)
        release(large)
        now = _state(links)
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def _state(links: DataFrame) -> tuple:
    """Sums that differ as soon as a link differs."""
    mixed = F.xxhash64("u", "v")
    return tuple(links.agg(F.count(F.lit(1)), F.sum(mixed % 1000003), F.sum(mixed % 998244353)).first())


def _star(links: DataFrame, large: bool) -> DataFrame:
    if large:
        sides = links.union(links.select("v", "u"))
    else:
        sides = links
    nearest = once(sides.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    joined = sides.join(nearest, "u")
    if large:  # neighbours above u go to u's smallest neighbour
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its neighbours below it go to the smallest one
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            nearest.select("u", F.col("m").alias("v"))
        )
    turned = once(moved.filter("u <> v").distinct())
    release(nearest)
    return turned
