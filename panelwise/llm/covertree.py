"""Exact top-k search by inner product: cover trees over queries and data, searched together.

Data and queries are cut into blocks of bounded size, data near the same pivot going together. For each pair of
blocks a task builds a tree over both and walks them together: no pair of a query of one node and a vector of
the other can score more than the product of their centres plus what the covering radii add, so a pair of nodes is
left out once this is below the worst kth score of the query node's group.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.session import cut

LEAF = 64
_LEAST = np.iinfo(np.int64).min


class Node:
    """Points ``order[low:high]``, all within ``radius`` of ``center``."""

    __slots__ = ("center", "radius", "low", "high", "children")

    def __init__(self, center, radius, low, high):
        self.center, self.radius, self.low, self.high, self.children = center, radius, low, high, []


def build(points: np.ndarray) -> tuple[Node | None, np.ndarray]:
    """A cover tree and the order of the points under it.

    The children of a node of radius ``r`` have centres more than ``r / 2`` apart and cover all its points within
    ``r / 2``. Children of few points stand together in one leaf.
    """
    order = np.arange(len(points))
    if not len(points):
        return None, order
    away = np.linalg.norm(points - points[0], axis=1)
    root = Node(points[0], float(away.max()), 0, len(points))
    waiting = [root]
    while waiting:
        node = waiting.pop()
        if node.high - node.low <= LEAF or node.radius == 0:
            continue
        rest, groups, small = order[node.low:node.high], [], []
        while len(rest):
            near = np.linalg.norm(points[rest] - points[rest[0]], axis=1) <= node.radius / 2
            inside = rest[near]
            if len(inside) > LEAF:
                groups.append(inside)
            else:
                small.append(inside)
            rest = rest[~near]
        if small:  # neighbours in the order of finding share a leaf
            few = np.concatenate(small)
            groups += [few[k:k + LEAF] for k in range(0, len(few), LEAF)]
        at = node.low
        for group in groups:
            order[at:at + len(group)] = group
            own = points[group]
            center = own[0] if len(group) > LEAF else own.mean(axis=0)
            radius = float(np.linalg.norm(own - center, axis=1).max())
            child = Node(center, radius, at, at + len(group))
            node.children.append(child)
            # equal points cannot be split further; a group as large as its node has a smaller radius
            waiting.append(child)
            at += len(group)
    return root, order


def _leaves(root: Node | None) -> list[Node]:
    found, waiting = [], [root] if root else []
    while waiting:
        node = waiting.pop()
        waiting += node.children
        if not node.children:
            found.append(node)
    return found


def search(
    queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray]:
    """For every query the ``k`` best integer products and their ids, ties to the smaller id, without the query's id.

    Places without a candidate hold the least integer as score.
    """
    scores = np.full((len(queries), k), _LEAST)
    ids = np.full((len(queries), k), np.iinfo(np.int64).max)
    query_root, query_order = build(queries.astype(float))
    root, order = build(data.astype(float))
    if root is None or query_root is None:
        return scores, ids
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, data.shape[1])
    exact = (lambda a, b: (a.astype(float) @ b.astype(float).T).astype(np.int64)) if largest < 2**52 else (
        lambda a, b: a @ b.T
    )
    for group in _leaves(query_root):
        for start in range(group.low, group.high, LEAF):
            members = query_order[start:min(start + LEAF, group.high)]
            _search_group(group, members, queries, query_ids, root, order, data, data_ids, scores, ids, exact)
    return scores, ids


def _search_group(group, members, queries, query_ids, root, order, data, data_ids, scores, ids, exact):
    size = float(np.linalg.norm(group.center))
    turn = 0
    heap = [(-np.inf, turn, root)]
    best, best_ids = scores[members], ids[members]
    while heap:
        bound, _, node = heapq.heappop(heap)
        worst = int(best[:, -1].min())
        if worst != _LEAST and -bound < worst:
            break
        for child in node.children:
            reach = float(np.linalg.norm(child.center))
            most = float(group.center @ child.center) + group.radius * reach + child.radius * (size + group.radius)
            turn += 1
            heapq.heappush(heap, (-(most + 1 + 1e-9 * abs(most)), turn, child))
        if node.children:
            continue
        for start in range(node.low, node.high, 1024):
            points = order[start:min(start + 1024, node.high)]
            found = exact(queries[members], data[points])
            names = np.broadcast_to(data_ids[points], found.shape)
            found = np.where(names == query_ids[members][:, None], _LEAST, found)
            all_scores = np.concatenate([best, found], axis=1)
            all_ids = np.concatenate([best_ids, names], axis=1)
            ranked = np.lexsort((all_ids, -(all_scores + (all_scores == _LEAST))), axis=1)[:, : best.shape[1]]
            best = np.take_along_axis(all_scores, ranked, axis=1)
            best_ids = np.take_along_axis(all_ids, ranked, axis=1)
    scores[members], ids[members] = best, best_ids


def top_k(
    vectors: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5,
    scale: int = 256, pivots: int = 64, block_rows: int = 8192, query_rows: int = 2048,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``k`` best vectors by integer product.

    Components become ``floor(scale * x)``. A query's own id is no candidate; ties go to the smaller id; with fewer
    candidates all are given. Rows without an id, with a null vector or with null or non-finite components take no
    part; a shorter vector counts as filled up with zeros. Rows that repeat an id are candidates each; as queries they
    are answered once, by one of their vectors. An empty table gives an empty result.

    ``pivots`` vectors, chosen by the hash of the id, only steer which data stand together. Blocks hold about
    ``block_rows`` vectors or ``query_rows`` queries; those of a pivot are dealt by the id's hash, so a vector that is
    repeated very often fills several blocks. Every block of data meets every block of queries, as the question is.
    """
    left = _prepared(vectors, vec_id, vector, scale)
    right = _prepared(queries, vec_id, vector, scale).dropDuplicates(["vec_id"])
    chosen = left.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    width = max([len(r["v"]) for r in chosen], default=0)
    centers = np.zeros((len(chosen), width))
    for row, r in enumerate(chosen):
        centers[row, : len(r["v"])] = r["v"]

    def nearest(batches):
        for batch in batches:
            held = _matrix(batch.column(1), width)[:, :width].astype(float)
            away = (centers**2).sum(1) - 2 * held @ centers.T
            near = away.argmin(axis=1) if len(centers) else np.zeros(len(held), int)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(near, pa.int32())], names=["vec_id", "v", "pivot"]
            )

    placed = cut(left.mapInArrow(nearest, "vec_id long, v array<long>, pivot int"))
    # at most `pivots` rows
    parts = {r["pivot"]: -(-r["n"] // block_rows) for r in placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()}
    split = F.element_at(F.array(*[F.lit(parts.get(p, 1)) for p in range(max(len(chosen), 1))]), F.col("pivot") + 1)
    right = cut(right)
    groups = max(1, -(-right.count() // query_rows))
    data_blocks = placed.groupBy("pivot", F.pmod(F.xxhash64("vec_id"), split).alias("part")).agg(
        F.collect_list(F.struct("vec_id", "v")).alias("data")
    )
    data_blocks = cut(data_blocks)
    query_blocks = right.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(groups)).alias("q")).agg(
        F.collect_list(F.struct("vec_id", "v")).alias("queries")
    )
    # a row for each pair of blocks, dealt over tasks by the block of data
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))
    keys = data_blocks.select("pivot", "part", F.explode(numbers).alias("q"))
    pairs = keys.join(query_blocks, "q").join(data_blocks, ["pivot", "part"])

    def meet(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                sides = []
                for name in ("queries", "data"):
                    held = batch.column(batch.schema.get_field_index(name))[row].values
                    sides.append((held.field("vec_id").to_numpy(), held.field("v")))
                wide = max(_widest(v) for _, v in sides)
                (qi, q), (di, x) = ((i, _matrix(v, wide)) for i, v in sides)
                scores, ids = search(q, qi, x, di, k)
                real = scores != _LEAST
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(qi, real.sum(1))), pa.array(ids[real]), pa.array(scores[real])],
                    names=["query_id", "vec_id", "score"],
                )

    found = pairs.select("queries", "data").mapInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _prepared(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    x = F.col(f"`{vector}`")
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.filter(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull() & usable).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.transform(x, lambda e: F.floor(scale * e.cast("double"))).alias("v"),
    )


def _widest(array: pa.Array) -> int:
    return int(max([len(v) for v in array], default=0)) if len(array) else 0


def _matrix(array: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows, filled up with zeros."""
    offsets = array.offsets.to_numpy()
    values = array.values.to_numpy()
    sizes = np.diff(offsets)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return values[offsets[0]:offsets[-1]].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[row, : b - a] = values[a:b]
    return out
