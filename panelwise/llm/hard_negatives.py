"""Hard negatives by inner product, from blocks of candidates in Hilbert order with zone maps.

Candidates are sorted by label and place on a Hilbert curve and cut into blocks; a block's zone map holds its range of
labels and each dimension's least and largest value. Interval arithmetic bounds the scores that an anchor can have in a
block: only blocks whose bounds meet one of the anchor's windows are read for it. Positives are the best of the anchor's
own label, above what its own block gives already; negatives the best of other labels inside the windows
that the positives' scores open.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import flat_lists, once, release

LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Rows of a block and anchors of a tile; wide vectors get fewer, so that neither is larger than ``UNIT_BYTES``.
BLOCK_ROWS, TILE_ROWS, UNIT_BYTES = 512, 1024, 4 << 20
#: Bits of every dimension in the order; zone maps that a task weighs at once; tiles whose best scores a task holds.
ORDER_BITS, ZONES, HELD_TILES = 4, 1024, 32

_BLOCK = (
    "block long, n int, least_label long, largest_label long, low array<long>, high array<long>, ids array<long>, "
    "labels array<long>, vectors array<long>, anchors array<struct<vec_id:long,label:long,v:array<long>,least:long>>"
)
_TILE = "tile long, ids array<long>, labels array<long>, vectors array<long>, lows array<long>, highs array<long>"


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The place of every row of ``cells`` (numbers below ``2 ** bits``) on a Hilbert curve, as bytes that sort by it."""
    x = np.ascontiguousarray(cells.T).astype(np.uint32)
    step = np.uint32(1 << (bits - 1))
    while step > 1:
        below = step - np.uint32(1)
        for i in range(len(x)):
            inverted = (x[i] & step) != 0
            swapped = np.where(inverted, np.uint32(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(inverted, below, swapped)
            x[i] ^= swapped
        step >>= np.uint32(1)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turned = np.zeros(x.shape[1], np.uint32)
    step = np.uint32(1 << (bits - 1))
    while step > 1:
        turned ^= np.where((x[-1] & step) != 0, step - np.uint32(1), np.uint32(0))
        step >>= np.uint32(1)
    x ^= turned
    planes = (x[None, :, :] >> np.arange(bits - 1, -1, -1, dtype=np.uint32)[:, None, None]) & np.uint32(1)
    packed = np.packbits(planes.reshape(bits * len(x), -1).astype(np.uint8), axis=0).T
    return [row.tobytes() for row in np.ascontiguousarray(packed)]


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest product that every anchor can have with a vector between ``low`` and ``high`` (one row a block)."""
    up, down = np.maximum(anchors, 0).astype(float), np.minimum(anchors, 0).astype(float)
    low, high = low.astype(float), high.astype(float)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = 1 + 1e-9 * (np.abs(anchors).astype(float) @ np.maximum(np.abs(low), np.abs(high)).T)
    return least - slack, most + slack


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of both."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(float) @ b.astype(float).T).astype(np.int64) if largest < 2**52 else a @ b.T


def candidate_rows(vectors: DataFrame, is_anchor: Column, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """``vec_id, label, v, anchor`` of the rows that take part, components as ``floor(scale * x)``."""
    x = F.col(f"`{vector}`")
    usable = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    whole = F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{label}`").isNotNull() & x.isNotNull() & usable
    return vectors.filter(whole).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"),
        F.transform(x, lambda e: F.floor(scale * e.cast("double"))).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )


def _matrix(array: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    values, borders = flat_lists(array)
    sizes = np.diff(borders)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(borders[:-1], sizes)] = values
    return out


def _unit(width: int, rows: int) -> int:
    return max(1, min(rows, UNIT_BYTES // (8 * width)))


def ordered_blocks(rows: DataFrame, width: int, least: int, largest: int, k: int) -> DataFrame:
    """Blocks with their zone maps. An anchor carries the ``k``-th best score of its label in its own block."""

    def keyed(batches):
        span = (largest - least + 1) / (1 << ORDER_BITS)
        for batch in batches:
            cells = ((_matrix(batch.column(2), width) - least) / span).astype(np.uint32)
            keys = hilbert_keys(np.minimum(cells, (1 << ORDER_BITS) - 1), ORDER_BITS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(keys, pa.binary())], names=["vec_id", "label", "v", "anchor", "key"]
            )

    def cut_up(batches):
        size, made = _unit(width, BLOCK_ROWS), 0
        first = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= size:
                rest = pa.Table.from_batches(held).combine_chunks()
                yield _block(rest.slice(0, size).combine_chunks(), first + made, width, k)
                made += 1
                held = rest.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield _block(pa.Table.from_batches(held).combine_chunks(), first + made, width, k)

    # the row number parts rows that are equal in all else, so that no value is one task's
    placed = rows.mapInArrow(keyed, "vec_id long, label long, v array<long>, anchor boolean, key binary").withColumn(
        "row", F.monotonically_increasing_id()
    )
    order = ["label", "key", "vec_id", "row"]
    dealt = once(placed).repartitionByRange(*order).sortWithinPartitions(*order).drop("key", "row")
    return dealt.mapInArrow(cut_up, _BLOCK)


def _block(rows: pa.Table, number: int, width: int, k: int) -> pa.RecordBatch:
    ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
    held = _matrix(rows.column("v").combine_chunks(), width)
    anchors = []
    marked = np.flatnonzero(rows.column("anchor").to_numpy(zero_copy_only=False))
    if len(marked):
        scores = products(held[marked], held)
        usable = (labels[marked][:, None] == labels) & (ids[marked][:, None] != ids)
        scores = np.where(usable, scores, LEAST)
        least = np.sort(scores, axis=1)[:, -k] if k <= len(ids) else np.full(len(marked), LEAST)
        anchors = [
            {"vec_id": int(ids[r]), "label": int(labels[r]), "v": held[r].tolist(), "least": int(s)}
            for r, s in zip(marked, least)
        ]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 5]
    values = [
        number, len(ids), int(labels.min()), int(labels.max()), held.min(axis=0), held.max(axis=0), ids, labels,
        held.reshape(-1),
    ]
    kind = pa.list_(pa.struct([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int64())), ("least", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [*[pa.array([v], t) for v, t in zip(values, kinds)], pa.array([anchors], kind)],
        names=[f.split()[0] for f in _BLOCK.split(", ")],
    )


def tiles(anchors: DataFrame, width: int, windows: int) -> DataFrame:
    """Anchors (``vec_id, label, v, near, lows, highs``) in the blocks' order, many to a row; ``windows`` of them each."""

    def packed(batches):
        size, made = _unit(width, TILE_ROWS), 0
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lows, highs = (np.full((part.num_rows, windows), fill, np.int64) for fill in (1, 0))
                for out, column in ((lows, "lows"), (highs, "highs")):
                    values, borders = flat_lists(part.column(part.schema.get_field_index(column)))
                    sizes = np.diff(borders)
                    place = np.arange(len(values)) - np.repeat(borders[:-1], sizes)
                    out[np.repeat(np.arange(len(sizes)), sizes), place] = values
                values = [
                    part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), width).reshape(-1),
                    lows.reshape(-1), highs.reshape(-1),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first + made]), *[pa.array([v], pa.list_(pa.int64())) for v in values]],
                    names=[f.split()[0] for f in _TILE.split(", ")],
                )
                made += 1

    order = ["label", "near", "vec_id"]
    dealt = anchors.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("vec_id", "label", "v", "lows", "highs").mapInArrow(packed, _TILE)


class _Side:
    """A tile's anchors out of a row of a batch."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda name: batch.column(batch.schema.get_field_index(name))[row].values.to_numpy()
        self.ids, self.labels = get("ids"), get("labels")
        self.vectors = get("vectors").reshape(len(self.ids), -1)
        self.lows, self.highs = (get(c).reshape(len(self.ids), -1) for c in ("lows", "highs"))


def choose_blocks(anchor_tiles: DataFrame, blocks: DataFrame, same: bool) -> DataFrame:
    """``tile, block, members``: the anchors of a tile for whose windows a block must be read, by zone maps alone.

    Every tile meets every group of zone maps; the zone maps are about one part in ``BLOCK_ROWS`` of the candidates.
    """
    zones = blocks.select("block", F.struct("block", "least_label", "largest_label", "low", "high").alias("zone"))
    groups = max(1, -(-blocks.count() // ZONES))
    grouped = zones.groupBy(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("_group")).agg(F.collect_list("zone").alias("zones"))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    meeting = anchor_tiles.withColumn("_group", numbers).join(grouped, "_group").drop("_group")

    def choose(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                side = _Side(batch, row)
                zone = batch.column(batch.schema.get_field_index("zones"))[row].values
                low, high = (_matrix(zone.field(c), side.vectors.shape[1]) for c in ("low", "high"))
                least, most = bounds(side.vectors, low, high)
                met = np.zeros(least.shape, bool)
                for w in range(side.lows.shape[1]):
                    a, b = side.lows[:, w, None], side.highs[:, w, None]
                    met |= (a <= b) & (most >= a) & (least <= b)
                first, last = zone.field("least_label").to_numpy(), zone.field("largest_label").to_numpy()
                own = side.labels[:, None]
                met &= ((first <= own) & (own <= last)) if same else ~((first == own) & (own == last))
                names = zone.field("block").to_numpy()
                used = np.flatnonzero(met.any(axis=0))
                tile = batch.column(batch.schema.get_field_index("tile"))[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(used), tile), pa.int64()), pa.array(names[used], pa.int64()),
                        pa.array([np.flatnonzero(met[:, z]).astype(np.int32) for z in used], pa.list_(pa.int32())),
                    ],
                    names=["tile", "block", "members"],
                )

    return meeting.mapInArrow(choose, "tile long, block long, members array<int>")


class _Best:
    """The ``k`` best scores and ids so far of every anchor of a tile in every window."""

    def __init__(self, side: _Side, k: int):
        self.side, self.k = side, k
        self.scores = np.full((*side.lows.shape, k), LEAST)
        self.ids = np.full((*side.lows.shape, k), MOST)

    def read(self, members, low, high, ids, labels, vectors, same: bool) -> None:
        side, worst = self.side, self.scores[:, :, -1]
        _, most = bounds(side.vectors[members], low[None], high[None])
        # an equal score may still win by its id
        members = members[(most >= worst[members]).any(axis=1)]
        if not len(members):
            return
        scores = products(side.vectors[members], vectors)
        usable = (side.labels[members][:, None] == labels) == same
        usable &= side.ids[members][:, None] != ids
        for w in range(side.lows.shape[1]):
            a, b = side.lows[members, w, None], side.highs[members, w, None]
            inside = np.where(usable & (scores >= a) & (scores <= b), scores, LEAST)
            floor = np.maximum(worst[members, w], LEAST + 1)
            if inside.shape[1] > self.k:
                floor = np.maximum(floor, np.partition(inside, -self.k, axis=1)[:, -self.k])
            row, column = np.nonzero(inside >= floor[:, None])
            if not len(row):
                continue
            touched = np.unique(row)
            at = members[touched]
            place = np.concatenate([np.searchsorted(touched, row), np.repeat(np.arange(len(at)), self.k)])
            found = np.concatenate([inside[row, column], self.scores[at, w].reshape(-1)])
            names = np.concatenate([ids[column], self.ids[at, w].reshape(-1)])
            order = np.lexsort((names, -(found + (found == LEAST)), place))
            starts = np.searchsorted(place[order], np.arange(len(at)))
            chosen = order[(starts[:, None] + np.arange(self.k)).reshape(-1)]
            self.scores[at, w] = found[chosen].reshape(-1, self.k)
            self.ids[at, w] = names[chosen].reshape(-1, self.k)

    def rows(self) -> pa.RecordBatch:
        anchor, window, place = np.nonzero(self.scores != LEAST)
        side = self.side
        columns = [
            side.ids[anchor], side.lows[anchor, window], side.highs[anchor, window],
            self.ids[anchor, window, place], self.scores[anchor, window, place],
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["anchor_id", "low", "high", "vec_id", "score"]
        )


def best_in_windows(anchors: DataFrame, blocks: DataFrame, width: int, windows: int, k: int, same: bool) -> DataFrame:
    """``anchor_id, low, high, vec_id, score, rank``: the ``k`` best candidates in each window of each anchor."""
    batch = max(1, (64 << 20) // (2 * 8 * width * _unit(width, TILE_ROWS)))
    anchor_tiles = once(tiles(anchors, width, windows))
    chosen = once(choose_blocks(anchor_tiles, blocks, same), batch)
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chosen.repartition(max(1, min(tasks, chosen.count() // 4)), "block")
    renamed = anchor_tiles.select("tile", F.struct("ids", "labels", "vectors", "lows", "highs").alias("side"))
    read = blocks.select("block", F.struct("low", "high", "ids", "labels", "vectors").alias("held"))
    meeting = dealt.join(renamed, "tile").join(read, "block").select("tile", "members", "side", "held")

    def score(batches):
        best: dict[int, _Best] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                tile = batch.column(0)[row].as_py()
                if tile not in best:
                    if len(best) >= HELD_TILES:
                        yield best.pop(next(iter(best))).rows()
                    part = pa.RecordBatch.from_struct_array(batch.column(2).slice(row, 1))
                    best[tile] = _Best(_Side(part, 0), k)
                held = {f: batch.column(3).field(f)[row].values.to_numpy() for f in ("low", "high", "ids", "labels", "vectors")}
                best[tile].read(
                    batch.column(1)[row].values.to_numpy(), held["low"], held["high"], held["ids"], held["labels"],
                    held["vectors"].reshape(len(held["ids"]), -1), same,
                )
        for last in best.values():
            yield last.rows()

    found = meeting.mapInArrow(score, "anchor_id long, low long, high long, vec_id long, score long")
    order = Window.partitionBy("anchor_id", "low", "high").orderBy(F.desc("score"), "vec_id")
    ranked = once(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), batch)
    release(anchor_tiles, chosen)
    return ranked


def _up(x: Column, percent: int) -> Column:
    """The least whole number with ``100 * y >= percent * x``."""
    return -_down(-x, percent)


def _down(x: Column, percent: int) -> Column:
    """The largest whole number with ``100 * y <= percent * x``."""
    product = x * percent
    return F.call_function("div", product - F.pmod(product, F.lit(100)), F.lit(100))


def mine(
    vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)`` and must fit in a long; a row's score is its product with the anchor, higher
    first, ties by smaller id. An anchor's positives are its ``positives`` first rows of the same label, its
    negatives the ``negatives`` first rows of another label whose score is between ``low_percent`` and ``high_percent`` of the positive's,
    both included. With fewer such rows all are given; a positive without negatives has no row.

    Rows without id, label or vector, or with null or non-finite components, take no part; shorter vectors are filled up
    with zeros. Rows that repeat an id are candidates each; as anchors they are answered once, by the smallest label and
    vector; rows with the anchor's id are none of its candidates. Other columns are not read, whatever their
    names; an empty table gives an empty result. Blocks, tiles and zone groups are of bounded size, so a hot label or a
    vector with very many copies fills many blocks.
    """
    rows = once(candidate_rows(vectors, is_anchor, vec_id, vector, label, scale))
    facts = rows.agg(
        F.max(F.size("v")).alias("width"), F.min(F.array_min("v")).alias("least"), F.max(F.array_max("v")).alias("largest")
    ).first()
    width = max(1, facts["width"] or 0)
    blocks = once(ordered_blocks(rows, width, facts["least"] or 0, facts["largest"] or 0, positives))
    anchors = once(
        blocks.select("block", F.inline("anchors"))
        .groupBy("vec_id").agg(F.min(F.struct("label", "v", "least", "block")).alias("row"))
        .select("vec_id", "row.label", "row.v", "row.least", F.col("row.block").alias("near"))
    )
    everything = anchors.select(
        "vec_id", "label", "v", "near", F.array("least").alias("lows"), F.array(F.lit(MOST)).alias("highs")
    )
    near = best_in_windows(everything, blocks, width, 1, positives, same=True)
    scored = once(
        near.select(
            "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"),
            _up(F.col("score"), low_percent).alias("low"), _down(F.col("score"), high_percent).alias("high"),
        ).filter("low <= high")
    )
    opened = scored.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set(F.struct("low", "high")).alias("w"))
    wanting = anchors.join(opened, "vec_id").select(
        "vec_id", "label", "v", "near", F.col("w.low").alias("lows"), F.col("w.high").alias("highs")
    )
    hard = best_in_windows(wanting, blocks, width, positives, negatives, same=False)
    result = once(
        scored.join(hard, ["anchor_id", "low", "high"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
    release(rows, blocks, anchors, near, scored, hard)
    return result
