"""Near duplicates by bottom-k sketches, inverted lists and exact similarity on full sets.

A document's set is hashed by one function and its ``k`` smallest hashes are its sketch. Linked documents share
so many sketch values that they also share one among the rarest of each (the prefix of the sketch, in the order
of frequency); inverted lists hold these values only, so frequent phrases give no lists. Lists are not paired
out: in each round every member is held against one leader of its list, which makes as many candidates as the
list has rows, and members already connected drop out. Documents in lists that still span several components are
then joined by the same prefix rule on their full sets, where it is exact and much tighter.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm import hashing
from panelwise.llm.common import any_names, carries, flat, lists, once, release, rows, utf8
from panelwise.llm.components import connected_components

#: Bytes of text that a task takes apart at once.
SLICE_BYTES = 1 << 19
WORDS = 5
#: Document ids that are sent to all tasks at most; beyond that the ids are joined by a shuffle.
SENT_IDS = 2_000_000
#: Odds against a linked pair sharing fewer sketch values than asked for.
ODDS = 1e-9


def shingle_sets(data: np.ndarray, borders: np.ndarray) -> list[np.ndarray]:
    """Each text's set of hashed shingles, sorted; a text of fewer words than a shingle has one of all its words."""
    texts = len(borders) - 1
    data = hashing.LOWER[data]
    start, stop, owner = hashing.words(data, borders)
    hashes = hashing.Slices(data).of(start, stop)
    firsts = np.searchsorted(owner, np.arange(texts + 1))
    by_size = {n: hashing.mix(hashing.runs(hashes, n) + np.uint64(n)).view(np.int64) for n in range(1, WORDS + 1)}
    out = []
    for a, b in zip(firsts[:-1], firsts[1:]):
        n = min(b - a, WORDS)
        out.append(np.unique(by_size[n][a:b - n + 1]) if n else np.zeros(0, np.int64))
    return out


def _digest(values: np.ndarray) -> tuple[int, int]:
    first = hashing.mix(values.view(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    second = hashing.mix(first + np.uint64(0x9E3779B97F4A7C15))
    signed = lambda x: int(np.add.reduce(x, dtype=np.uint64).view(np.int64)) if len(x) else 0
    return signed(first), signed(second)


def least_union(n: int, percent: int) -> int:
    return 100 * n // percent


def _quantile(union: int, k: int, percent: int) -> int:
    """Shared values in the bottom ``k`` of a union, for similarity ``percent``, that are missed with odds ``ODDS``."""
    both = -(-percent * union // 100)
    if union <= k:
        return both
    choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    total, below, t = choose(union, k), 0.0, max(0, k - (union - both))
    while t < k:
        below += math.exp(choose(both, t) + choose(union - both, k - t) - total)
        if below > ODDS:
            break
        t += 1
    return t


@functools.cache
def needed(k: int, percent: int, sizes: int = 2000) -> list[int]:
    """By set size, the sketch values that linked sets share at least; the last entry holds for larger sets."""
    at = [_quantile(u, k, percent) for u in range(least_union(sizes, percent) + 2)]
    large = _quantile(10**7, k, percent)
    return [min(at[n], at[least_union(n, percent)]) for n in range(sizes)] + [min(large, at[-1])]


def _similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _inverted(values: DataFrame, share: Column) -> DataFrame:
    """``value``, ``rep``, ``n`` for the rarest values of each set that others hold too; ``alone`` is how many values it
    holds alone, ``at`` the value's place among the others from the rarest on.

    ``values`` has ``rep``, ``n``, ``held`` (values it brings) and ``value``; ``share`` is the least number that linked
    sets have in common. Values of one set alone are the rarest, so they only use up places.
    """
    common = once(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"))
    by_rep = values.join(common, "value").groupBy("rep", "n", "held").agg(
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found")
    )
    places = F.greatest(F.size("found") - share + 1, F.lit(0))
    front = by_rep.filter(places > 0).select(
        "rep", "n", (F.col("held") - F.size("found")).alias("alone"),
        F.transform(F.slice("found", F.lit(1), places.cast("int")), lambda f: f["value"]).alias("front"),
    )
    return front.select("rep", "n", "alone", F.posexplode("front").alias("at", "value"))


def _estimate_filter(pairs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose union's bottom ``k`` holds enough shared values."""
    side = lambda name: reps.select(F.col("rep").alias(name), F.col("sketch").alias(f"s{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    least = F.array(*[F.lit(t) for t in needed(k, percent)])
    ask = F.least(*[F.element_at(least, F.least(F.col(n), F.lit(2000)) + 1) for n in ("na", "nb")])
    return both.filter(shared >= ask).select("a", "b")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int, together: int = 256) -> DataFrame:
    """The pairs ``a``, ``b`` whose full sets have the similarity.

    A leader ``a`` meets its partners as a sorted stream, so a task holds one leader's set at a time; a leader with
    many partners is split into parts of about ``together``.
    """
    counts = once(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / together).alias("parts")))
    parted = pairs.join(counts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    partners = parted.join(sets, F.col("b") == F.col("rep")).select("a", "part", F.lit(1).alias("side"), "b", "members")
    leaders = parted.select("a", "part").distinct().join(sets, F.col("a") == F.col("rep")).select(
        "a", "part", F.lit(0).alias("side"), F.col("a").alias("b"), "members"
    )
    stream = leaders.union(partners).repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def compare(batches):
        leader, held = None, None
        for batch in batches:
            owners, sides, others = (batch.column(k).to_pylist() for k in (0, 2, 3))
            members, found = batch.column(4), []
            for row, (a, side, b) in enumerate(zip(owners, sides, others)):
                values = np.frombuffer(members[row].as_py(), np.int64)
                if side == 0:
                    leader, held = a, values
                    continue
                assert leader == a
                both = len(np.intersect1d(held, values, assume_unique=True))
                if 100 * both >= percent * (len(held) + len(values) - both):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
            )

    confirmed = once(stream.mapInArrow(compare, "a long, b long"))
    release(counts)
    return confirmed


@any_names
def find_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, k: int = 64, rounds: int = 1,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) plus ``n_shingles``, ``component_id``, ``kept`` and ``repeated``.

    Two documents are linked if ``100 * intersection >= percent * union`` of their sets of five-word shingles.
    ``component_id`` is the smallest id reachable over links, ``kept`` says that it is the row's own. Texts without
    words, null texts among them, have an empty set and are linked with nothing. Rows that share an id count as one
    document; ``repeated`` marks all but one of the rows that share both id and set. Rows without an id have no
    component, are linked with nothing and kept. Columns of ``docs`` with the new names are replaced; an empty
    table gives an empty result.
    """
    new = ["n_shingles", "component_id", "kept", "repeated"]
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    # a text that is carried goes to the tasks once
    own_text = [] if carries(docs, text, carried) else [utf8(text).alias("_text")]
    read, width = "_text" if own_text else text, len(carried) + 1
    spent = []

    def hold(df):
        spent.append(once(df))
        return spent[-1]

    def sketch(batches):
        for batch in rows(batches, read, SLICE_BYTES):
            sets = shingle_sets(*flat(batch.column(batch.schema.get_field_index(read))))
            digests = [_digest(s) for s in sets]
            fronts = [s[:k] for s in sets]
            values = np.concatenate(fronts) if fronts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:width], pa.array([len(s) for s in sets], pa.int32()),
                    *[pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)],
                    lists(values, np.concatenate([[0], np.cumsum([len(f) for f in fronts])]), pa.int64()),
                ],
                names=[*batch.schema.names[:width], "_n", "_d1", "_d2", "_sketch"],
            )

    chosen = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{doc_id}`").cast("long").alias("_id"), *own_text)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema if f.name != "_text")
    marked = once(
        chosen.mapInArrow(sketch, fields + "_n int, _d1 long, _d2 long, _sketch array<long>")
        .withColumn("_row", F.monotonically_increasing_id())
    )
    known = marked.filter("_n > 0 and _id is not null")
    # a set is known by its digest: an id may have rows with several sets, and equal sets have several ids
    key = ["_n", "_d1", "_d2"]
    reps = once(
        known.groupBy(*key).agg(
            F.min("_row").alias("rep"), F.min("_id").alias("least"), F.first("_sketch").alias("sketch"), F.first("_n").alias("n")
        )
    )
    # an id that has rows with different sets links these sets
    held = hold(known.select("_id", *key).distinct().join(reps.select(*key, "rep"), key).select("_id", "rep"))
    several = hold(held.groupBy("_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b").select("_id", "a"))
    same_id = hold(held.join(several, "_id").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct())

    ask = F.element_at(F.array(*[F.lit(t) for t in needed(k, percent)]), F.least(F.col("n"), F.lit(2000)) + 1)
    values = reps.select("rep", "n", F.size("sketch").alias("held"), F.explode("sketch").alias("value"))
    entries = hold(_inverted(values, ask).select("value", "rep", "n", "alone"))
    shared = entries.groupBy("value").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("value")
    entries = hold(entries.join(shared, "value"))

    active = hold(reps.join(entries.select("rep").distinct(), "rep").select("rep", "least", *key))
    number = active.count()
    ids = active.select(F.col("least").alias("id"))
    ids = F.broadcast(ids) if number <= SENT_IDS else ids
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), utf8(text).alias("_text")).join(ids, "id", "left_semi")

    def full_sets(batches):
        for batch in rows(batches, "_text", SLICE_BYTES):
            sets = shingle_sets(*flat(batch.column(1)))
            digests = [_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([len(s) for s in sets], pa.int32()), *[pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1)],
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=[*key, "members"],
            )

    every = texts.mapInArrow(full_sets, "_n int, _d1 long, _d2 long, members binary")
    # an id may have rows with other sets than those that are asked for
    sets = hold(
        every.dropDuplicates(key).join(active.select(*key, "rep"), key).select("rep", F.col("_n").alias("size"), "members")
    )

    edges = same_id
    for turn in range(rounds):
        parts = None if turn == 0 else hold(connected_components(edges))
        pairs = _estimate_filter(_stars(entries, parts, turn, percent), reps, k, percent)
        found = _confirm(hold(pairs), sets, percent)
        spent.append(found)
        edges = edges.union(found)
    parts = hold(connected_components(edges))
    placed = hold(_with_parts(entries, parts))
    open_lists = placed.groupBy("value").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high")
    rest = placed.join(open_lists, "value", "left_semi").select("rep", "part").distinct()

    def spread(batches):
        for batch in rows(batches, "members"):
            data, borders = flat(batch.column(3))
            counts = np.diff(borders) // 8
            again = lambda c: np.repeat(batch.column(c).to_numpy(), counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(again(0)), pa.array(again(1)), pa.array(again(2)), pa.array(np.frombuffer(data.tobytes(), np.int64))],
                names=["rep", "part", "n", "value"],
            )

    open_sets = sets.join(rest, "rep").select("rep", "part", F.col("size").alias("n"), "members")
    full = hold(open_sets.mapInArrow(spread, "rep long, part long, n int, value long")).withColumn("held", F.col("n"))
    tight = hold(_inverted(full.select("rep", "n", "held", "value"), F.ceil(percent * F.col("n") / 100)))
    pairs = _stars(tight.select("value", "rep", "n", "alone"), parts, rounds, percent)
    found = _confirm(hold(pairs), sets, percent)
    spent.append(found)
    edges = edges.union(found)
    parts = hold(connected_components(edges))
    tight = hold(_with_parts(tight, parts))
    side = lambda x: tight.select(
        "value", F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("part").alias(f"p{x}"),
        (F.col("n") - F.col("alone") - F.col("at")).alias(f"left{x}"),
    )
    # at a linked pair's rarest common value enough is left behind it in both sets
    both = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
    pairs = side("a").withColumnRenamed("value", "va").join(
        side("b"),
        (F.col("va") == F.col("value")) & (F.col("pa") < F.col("pb")) & _similar_sizes(F.col("na"), F.col("nb"), percent)
        & (F.col("lefta") >= both) & (F.col("leftb") >= both),
    ).select("a", "b").distinct()
    found = _confirm(hold(pairs), sets, percent)
    spent.append(found)
    edges = edges.union(found)
    final = hold(connected_components(edges))

    # a component is named by the smallest id of its sets
    placed = hold(reps.select(*key, "rep", "least").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        *key, "least", F.coalesce("component", "rep").alias("component")
    ))
    smallest = hold(placed.groupBy("component").agg(F.min("least").alias("named")))
    names = once(placed.join(smallest, "component").select(*key, "named"))
    release(*spent, reps)

    named = marked.select("_row", "_id", *key).join(names, key, "left")
    first = marked.groupBy("_id", *key).agg(F.min("_row").alias("_row")).select("_row", F.lit(False).alias("again"))
    own = F.when(F.col("_id").isNotNull(), F.coalesce("named", "_id"))
    flags = named.join(first, "_row", "left").select(
        "_row", F.col("_n").cast("long").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(own == F.col("_id"), F.lit(True)).alias("kept"),
        (F.coalesce("again", F.lit(True)) & F.col("_id").isNotNull()).alias("repeated"),
    )
    wide = marked.select("_row", *carried)
    return wide.join(flags, "_row").select(*carried, *new)


def _stars(entries: DataFrame, parts: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """Pairs of each list's leader with its members of other components, each pair once.

    The leader is the member that holds the fewest values alone, then the one with the least hash. An original whose
    copies differ from each other is linked with more of them than any copy is, and lists that share members mostly
    share the leader.
    """
    placed = _with_parts(entries, parts)
    order = F.struct(F.col("alone"), F.xxhash64("rep", F.lit(turn)).alias("mixed"), F.col("rep"), F.col("n"), F.col("part"))
    leaders = placed.groupBy("value").agg(
        F.min(order).alias("leader"), F.min("part").alias("low"), F.max("part").alias("high")
    ).filter("low <> high").select(
        "value", F.col("leader.rep").alias("a"), F.col("leader.n").alias("na"), F.col("leader.part").alias("pa")
    )
    return placed.join(once(leaders), "value").filter(
        (F.col("pa") != F.col("part")) & _similar_sizes(F.col("n"), F.col("na"), percent)
    ).select("a", "na", F.col("rep").alias("b"), F.col("n").alias("nb")).distinct()


def _with_parts(entries: DataFrame, parts: DataFrame | None) -> DataFrame:
    if parts is None:
        return entries.withColumn("part", F.col("rep"))
    named = parts.select(F.col("node").alias("rep"), F.col("component"))
    return entries.join(named, "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
