"""Hard negatives against brute force, on odd, repeated, tied, clustered and missing vectors."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.llm import hard_negatives
from panelwise.llm.common import once

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, block int, v string"


def brute_force(rows, is_anchor, width, positives=5, negatives=3):
    usable = []
    for vec_id, x, label, *_ in rows:
        if vec_id is None or x is None or label is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        whole = [int(np.floor(256 * float(np.float32(c)))) for c in x]
        usable.append((vec_id, label, (*whole, *[0] * (width - len(whole)))))
    anchors = {}
    for row in usable:
        if is_anchor(row[0]):
            anchors[row[0]] = min(anchors.get(row[0], row), row, key=lambda r: r[1:])
    out = []
    for anchor, label, a in anchors.values():
        scored = sorted((-sum(p * q for p, q in zip(a, c)), i, k == label) for i, k, c in usable if i != anchor)
        for s, i, _ in [r for r in scored if r[2]][:positives]:
            found = [(t, j) for t, j, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:negatives]
            out += [(anchor, i, n, j, -s, -t) for n, (t, j) in enumerate(found, 1)]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ).collect())


@pytest.fixture(scope="module")
def odd_rows():
    pick = random.Random(11)
    draw = lambda: [pick.gauss(0, 0.4) for _ in range(6)]
    rows = [(i, draw(), pick.randrange(3)) for i in range(240)]
    rows += [(i, [0.5, -0.25, 0.0, 0.5, 0.0, 0.125], i % 2) for i in range(240, 330)]  # equal vectors: ties by id
    rows += [(5, draw(), 1), (5, draw(), 0), (0, draw(), 2), (400, [0.25, 0.5], 1), (401, [], 2)]
    rows += [(None, draw(), 1), (410, None, 1), (411, draw(), None), (412, [0.1, None], 1), (413, [float("nan")] * 6, 1)]
    rows += [(414, [float("inf")] + [0.0] * 5, 0), (415, [0.0] * 6, 0), (416, [2000.0] * 6, 2)]
    return [(*r, "x", 1, "y") for r in rows]


def test_odd_rows(spark, odd_rows):
    frame = spark.createDataFrame(odd_rows, SCHEMA).repartition(5)
    got = hard_negatives.mine(frame, F.col("vec_id") % 5 == 0)
    assert rows_of(got) == brute_force(odd_rows, lambda i: i % 5 == 0, 6)


def test_small_blocks_tiles_and_zone_groups(spark, odd_rows):
    frame = spark.createDataFrame(odd_rows, SCHEMA)
    before = hard_negatives.BLOCK_ROWS, hard_negatives.TILE_ROWS, hard_negatives.ZONES, hard_negatives.HELD_TILES
    hard_negatives.BLOCK_ROWS, hard_negatives.TILE_ROWS, hard_negatives.ZONES, hard_negatives.HELD_TILES = 7, 4, 5, 2
    try:
        got = rows_of(hard_negatives.mine(frame, F.col("vec_id") % 5 == 0))
    finally:
        (
            hard_negatives.BLOCK_ROWS, hard_negatives.TILE_ROWS, hard_negatives.ZONES, hard_negatives.HELD_TILES
        ) = before
    assert got == brute_force(odd_rows, lambda i: i % 5 == 0, 6)


def test_zone_maps_leave_blocks_out(spark):
    """Clustered vectors: most pairs of anchor and block are never read, and no result is lost."""
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(12, 8))
    rows = [
        (i, (centres[i % 12] + pick.normal(scale=0.05, size=8)).tolist(), i % 4, "x", 1, "y") for i in range(1200)
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    anchored = F.col("vec_id") % 10 == 0
    before = hard_negatives.BLOCK_ROWS
    hard_negatives.BLOCK_ROWS = 20
    try:
        held = once(hard_negatives.candidate_rows(frame, anchored, "vec_id", "embedding", "label", 256))
        facts = held.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
        blocks = once(hard_negatives.ordered_blocks(held, 8, facts[0], facts[1], 5))
        anchors = blocks.select("block", F.inline("anchors")).select(
            "vec_id", "label", "v", F.col("block").alias("near"), F.array("least").alias("lows"),
            F.array(F.lit(hard_negatives.MOST)).alias("highs"),
        )
        chosen = hard_negatives.choose_blocks(once(hard_negatives.tiles(anchors, 8, 1)), blocks, same=True)
        pairs = chosen.agg(F.sum(F.size("members"))).first()[0]
        assert pairs < 0.2 * 120 * blocks.count()
        got = rows_of(hard_negatives.mine(frame, anchored))
    finally:
        hard_negatives.BLOCK_ROWS = before
    assert got == brute_force(rows, lambda i: i % 10 == 0, 8)


@pytest.mark.parametrize("dimensions, bits", [(2, 3), (3, 2), (4, 2)])
def test_the_curve_visits_neighbours(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = hard_negatives.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold():
    pick = np.random.default_rng(5)
    anchors, held = pick.integers(-300, 300, (20, 9)), pick.integers(-300, 300, (50, 9))
    least, most = hard_negatives.bounds(anchors, held.min(axis=0)[None], held.max(axis=0)[None])
    scores = hard_negatives.products(anchors, held)
    assert (least[:, 0] <= scores.min(axis=1)).all() and (most[:, 0] >= scores.max(axis=1)).all()
    huge = np.array([[2**30, -(2**30)]])
    assert hard_negatives.products(huge, huge).tolist() == [[2**61]]


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(empty, F.col("vec_id") % 5 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0], 1, "x", 1, "y"), (1, None, 1, "x", 1, "y")], SCHEMA)
    assert hard_negatives.mine(alone, F.lit(True)).collect() == []
