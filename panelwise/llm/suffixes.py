"""Order of all suffixes of many strings by the difference-cover algorithm, as Spark jobs.

Suffixes at places 1 and 2 modulo 3 are the sample. Their triples of letters are sorted and named by the number of
smaller ones; the names form strings of a third of the length, whose suffixes are ordered by the same step. The
other suffixes are merged in by counting: a suffix at a place 0 modulo 3 and one of the sample compare by one letter, or
two, and the rank of a sampled suffix behind; so two sorts of distinct keys with running sums tell how many suffixes of
the other kind are smaller. All sorts run over distinct keys with their counts, so repeated strings make no hot key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import flat_lists, lists, once, places, release, rows
from panelwise.operators.ranking import running_totals

#: Letters that a task handles at once; a longer string is handled alone.
LETTERS = 1 << 16


def _ahead(values: np.ndarray, borders: np.ndarray, step: int) -> np.ndarray:
    """The value ``step`` places on in the same list, 0 behind its end."""
    out = np.zeros(len(values), np.int64)
    if len(values) > step:
        out[:-step] = values[step:]
    out[(np.repeat(borders[1:], np.diff(borders)) - np.arange(len(values))) <= step] = 0
    return out


def _arrays(found: DataFrame, by: list[str]) -> DataFrame:
    """``sid`` and the sums of ``value`` by ``place``, as an array in order of place."""

    def fill(batches):
        for batch in rows(batches, "pairs", LETTERS):
            pairs = batch.column(1)
            place = pairs.values.field("place").to_numpy()
            value = pairs.values.field("value").to_numpy()
            offsets = pairs.offsets.to_numpy()
            outs = []
            for a, b in zip(offsets[:-1], offsets[1:]):
                # a place without a value holds 0
                out = np.zeros(place[a:b].max() + 1, np.int64)
                np.add.at(out, place[a:b], value[a:b])
                outs.append(out)
            borders = np.concatenate([[0], np.cumsum([len(o) for o in outs])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists(np.concatenate(outs) if outs else np.zeros(0, np.int64), borders, pa.int64())],
                names=["sid", "ranks"],
            )

    grouped = found.groupBy(*by).agg(F.collect_list(F.struct("place", "value")).alias("pairs"))
    return grouped.mapInArrow(fill, "sid long, ranks array<long>")


def suffix_ranks(strings: DataFrame, depth: int) -> DataFrame:
    """``sid``, ``ranks``: for every place of a string, 1 + the number of smaller suffixes of all strings.

    ``strings`` has ``sid`` (unique) and ``letters`` (positive numbers, at least one). Suffixes that agree in their first
    ``depth`` letters may share a rank, and equal suffixes always do; a suffix that ends is smaller than one that goes on.
    """

    def triples(batches):
        for batch in rows(batches, "letters", LETTERS):
            letters, borders = flat_lists(batch.column(1))
            place = places(borders)
            kept = place % 3 != 0
            sid = np.repeat(batch.column(0).to_numpy(), np.diff(borders))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(sid[kept]), pa.array(place[kept].astype(np.int32)), pa.array(letters[kept]),
                    *[pa.array(_ahead(letters, borders, s)[kept]) for s in (1, 2)],
                ],
                names=["sid", "place", "a", "b", "c"],
            )

    letters = ["a", "b", "c"]
    sample = once(strings.mapInArrow(triples, "sid long, place int, a long, b long, c long"))
    if depth > 3:
        # names have the triples' order and no more: the number of a range, and the place in it
        ranged = sample.select(*letters).distinct().repartitionByRange(*letters).sortWithinPartitions(*letters)
        names = once(ranged.withColumn("value", F.monotonically_increasing_id() + 1))
    else:
        distinct = sample.groupBy(*letters).agg(F.count(F.lit(1)).alias("n"))
        totals = running_totals(distinct, letters, ["n"])
        names = once(totals.select(*letters, (F.col("n_upto") - F.col("n") + 1).alias("value")))
        release(totals)
    named = sample.join(names, letters).select("sid", "place", "value")
    if depth > 3:
        residue = F.col("place") % 3 - 1
        inner = named.select(
            (F.col("sid") * 2 + residue).alias("sid"), F.floor(F.col("place") / 3).cast("int").alias("place"), "value"
        )
        inner = once(_arrays(inner, ["sid"]).withColumnRenamed("ranks", "letters"))
        release(sample, names)
        halves = suffix_ranks(inner, -(-depth // 3))
        release(inner)
    else:
        halves = once(_arrays(
            named.select(
                (F.col("sid") * 2 + F.col("place") % 3 - 1).alias("sid"),
                F.floor(F.col("place") / 3).cast("int").alias("place"), "value",
            ),
            ["sid"],
        ))
        release(sample, names)
    none = F.array().cast("array<long>")
    of = lambda r: halves.filter(F.pmod("sid", F.lit(2)) == r).select(
        F.shiftright("sid", 1).alias("sid"), F.col("ranks").alias(f"r{r + 1}")
    )
    both = strings.select("sid", "letters").join(of(0), "sid", "left").join(of(1), "sid", "left").select(
        "sid", "letters", F.coalesce("r1", none).alias("r1"), F.coalesce("r2", none).alias("r2")
    )

    def keys(batches):
        for batch in rows(batches, "letters", LETTERS):
            letters, borders = flat_lists(batch.column(1))
            place = places(borders)
            sid = np.repeat(batch.column(0).to_numpy(), np.diff(borders))
            ranks = np.zeros(len(letters), np.int64)
            for residue in (1, 2):
                ranks[place % 3 == residue] = flat_lists(batch.column(1 + residue))[0]
            one, two = _ahead(letters, borders, 1), _ahead(ranks, borders, 2)
            behind = _ahead(ranks, borders, 1)
            parts = []
            for kind, other in ((0, 1), (1, 2)):
                for residue in (0, other):
                    at = np.flatnonzero(place % 3 == residue)
                    second, third = (behind, np.zeros_like(behind)) if kind == 0 else (one, two)
                    parts.append((sid[at], place[at], np.full(len(at), kind), letters[at], second[at], third[at], ranks[at]))
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*_KEYS])

    merged = once(both.mapInArrow(keys, ", ".join(f"{c} long" for c in _KEYS)))
    release(halves)
    key = ["kind", "x", "y", "z"]
    zero = F.col("place") % 3 == 0
    counts = merged.groupBy(*key).agg(
        F.count(F.when(zero, 1)).alias("plain"), F.count(F.when(~zero, 1)).alias("sampled")
    )
    totals = running_totals(counts, key[1:], ["plain", "sampled"], ["kind"])
    below = once(totals.select(
        *key, (F.col("plain_upto") - F.col("plain")).alias("plain"), (F.col("sampled_upto") - F.col("sampled")).alias("sampled")
    ))
    release(totals)
    # a plain suffix sums its smaller plain ones once and its smaller sampled ones from both kinds of keys
    value = F.when(zero & (F.col("kind") == 0), F.col("plain") + F.col("sampled") + 1).when(
        zero, F.col("sampled")
    ).otherwise(F.col("rank") + F.col("plain"))
    ranks = once(_arrays(
        merged.join(below, key).select("sid", F.col("place").cast("int").alias("place"), value.alias("value")), ["sid"]
    ))
    release(merged, below)
    return ranks


_KEYS = ["sid", "place", "kind", "x", "y", "z", "rank"]


def common_prefixes(prefixes: DataFrame, kind: type = np.int64) -> DataFrame:
    """``rank``, ``shared``: how many leading letters a suffix shares with any other one.

    ``prefixes`` has a row for every suffix, with ``rank`` and ``prefix``, its first letters as numbers of ``kind`` (binary).
    Neighbours in the order share most, so each rank is held against the next one on both sides; ranks are
    dealt in ranges, and of each range the first and last are held against the neighbouring ranges.
    """
    classes = prefixes.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.first("prefix").alias("prefix"))

    def compare(batches):
        last, pending = None, None
        for batch in batches:
            out = []
            for rank, n, prefix in zip(*[c.to_pylist() for c in batch.columns]):
                letters = np.frombuffer(prefix, kind)
                shared = _agree(last, letters) if pending else 0
                own = len(letters) if n > 1 else 0
                if pending:
                    pending[1] = max(pending[1], shared)
                    out.append(pending)
                pending = [rank, max(own, shared), prefix if pending is None else None]
                last = letters
            if out:
                yield _rows(out)
        if pending:
            pending[2] = last.tobytes()
            yield _rows([pending])

    def _rows(out):
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary())],
            names=["rank", "shared", "edge"],
        )

    sliced = once(
        classes.repartitionByRange("rank").sortWithinPartitions("rank").mapInArrow(compare, "rank long, shared long, edge binary")
    )
    # at most two rows for each range
    edges = sliced.filter("edge is not null").orderBy("rank").collect()
    held = {}
    for a, b in zip(edges[:-1], edges[1:]):
        n = _agree(np.frombuffer(a["edge"], kind), np.frombuffer(b["edge"], kind))
        for r in (a, b):
            held[r["rank"]] = max(held.get(r["rank"], 0), n)
    spark = prefixes.sparkSession
    across = spark.createDataFrame(list(held.items()), "rank long, across long")
    return sliced.join(F.broadcast(across), "rank", "left").select(
        "rank", F.greatest("shared", F.coalesce("across", F.lit(0))).alias("shared")
    )


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n
