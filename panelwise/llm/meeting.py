"""Keys of many blocks of rows meet in ranges of their values.

A block holds its keys packed in one row. It sends a row to each range that it has keys of, and gets a byte for each key
back, so that Spark deals and groups rows by block and range in place of one for every key. A key goes once from a
block to its range, however often the block has it, so a frequent key makes no range large.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of keys in a range; a task that judges one holds about ten times as many.
RANGE_BYTES = 4 << 20
_LOW = np.uint64(1)


def numbers(batch: pa.RecordBatch, column: str, row: int, kind: type = np.int64) -> np.ndarray:
    """The packed numbers of one row."""
    return np.frombuffer(batch.column(batch.schema.get_field_index(column))[row].as_buffer(), kind)


def answers(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    """The bytes that ``meet`` gave the keys of one row's block, in the order of its keys."""
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index(column))[row].as_py()), np.uint8)


def distinct(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct columns of ``lines`` in ascending order, where each column lies in it, and the place of the first of each."""
    order = np.argsort(lines[0], kind="stable") if len(lines) == 1 else np.lexsort(lines[::-1])
    ordered = lines[:, order]
    new = np.ones(len(order), bool)
    new[1:] = (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[:, new], inverse, order[new]


def counted(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``distinct``, without the lowest bit of the last line, which then says that a column is there several times."""
    lines = lines.copy()
    lines[-1] &= ~_LOW
    keys, inverse, first = distinct(lines)
    keys[-1] |= (np.bincount(inverse, minlength=keys.shape[1]) > 1).astype(np.uint64)
    return keys, inverse, first


def several(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column from ``counted`` of many blocks: whether it is there several times, and whether it is the first of its kind."""
    keys, inverse, first = counted(lines)
    many = (keys[-1] & _LOW).astype(bool)
    many |= np.bincount(inverse, lines[-1] & _LOW, keys.shape[1]) > 0
    lead = np.zeros(lines.shape[1], bool)
    lead[first] = True
    return many[inverse], lead


def meet(
    blocks: DataFrame, name: str, size: Column, keys: Callable[[pa.RecordBatch, int], np.ndarray],
    judge: Callable[[np.ndarray], np.ndarray],
) -> DataFrame:
    """``block`` and, under ``name``, what ``answers`` reads: a byte for each key of a block. Blocks without keys have no row.

    ``keys`` makes of a batch and a row's number an array of 64-bit lines; the first one ascends and is spread over all
    64-bit numbers. ``judge`` gets these columns of all blocks for a range, in any order, and gives a byte for each.
    ``size`` is about the bytes of a block's keys.
    """
    spark = blocks.sparkSession
    total = blocks.agg(F.sum(size)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_BYTES + 1)
    edges = np.array([-(-(r << 64) // ranges) for r in range(1, ranges)], np.uint64)

    def deal(batches):
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("block")).to_numpy()
            for row in range(batch.num_rows):
                made = keys(batch, row)
                borders = np.concatenate([[0], np.searchsorted(made[0], edges), [made.shape[1]]])
                used = np.flatnonzero(np.diff(borders))
                parts = [made[:, borders[r]:borders[r + 1]].tobytes() for r in used]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int32)), pa.array(np.full(len(used), own[row])),
                        pa.array(np.full(len(used), len(made), np.int32)), pa.array(parts, pa.binary()),
                    ],
                    names=["range", "block", "lines", "data"],
                )

    def answer(table):
        lines = table.column("lines")[0].as_py()
        parts = [np.frombuffer(x.as_buffer(), np.uint64).reshape(lines, -1) for x in table.column("data")]
        found = judge(np.concatenate(parts, axis=1)).astype(np.uint8)
        borders = np.cumsum([p.shape[1] for p in parts])
        return pa.table({
            "block": table.column("block"), "range": table.column("range"),
            "found": pa.array([x.tobytes() for x in np.split(found, borders[:-1])], pa.binary()),
        })

    dealt = blocks.mapInArrow(deal, "range int, block long, lines int, data binary")
    judged = dealt.groupBy("range").applyInArrow(answer, "block long, range int, found binary")
    return judged.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "found"))).alias(name)).select(
        "block", F.transform(name, lambda x: x["found"]).alias(name)
    )
