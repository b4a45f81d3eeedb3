"""Removal of long repeated byte strings, over a suffix order of phrases.

Texts are cut into phrases at anchors, the least hashed 16-byte strings of each sliding window. Anchors depend on the bytes
around them alone, so equal strings of ``length`` bytes contain the same phrases, but for their first and last bytes. Their
phrases are at least ``Grid.least`` bytes long together; where no such run of phrases occurs twice, nothing is repeated,
and what is left are the repeated runs with their margins. Phrases that occur only together, and equal phrases in a row, are
one letter each. The suffixes of the runs are put in order by the difference-cover algorithm (``suffixes``) over these
letters, and neighbours in the order tell how far each place repeats, or, where a row of equal phrases may be as long
elsewhere or not, how far it does at most. Only windows of ``length`` bytes whose phrases
repeat as a whole remain as candidates. Equal surroundings of an anchor settle all its windows at once; windows in
surroundings that occur once, at the borders of repeats, are compared one by one, by 128-bit hashes.

Phrases, anchors and windows of some megabytes of texts lie packed in one row, and meet others of their kind by ``meeting``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm import hashing
from panelwise.llm.common import any_names, carries, flat, flat_lists, lists, once, release, rows, utf8
from panelwise.llm.meeting import answers, counted, distinct, meet, numbers, several
from panelwise.llm.suffixes import LETTERS, common_prefixes, suffix_ranks

GRAM = 16
_LETTER = np.uint64((1 << 62) - 1)
#: Bytes of text that a task handles at once here.
SLICE_BYTES = 1 << 19
#: Bytes of text in a block of phrases and in one of runs, and blocks that a task handles at once.
BLOCK_BYTES, RUN_BYTES, BLOCK_ROWS = 2 << 20, 1 << 19, 2
#: Bytes of texts whose phrases are found at once, or of runs that are hashed at once; their arrays fit a core's cache.
PIECE_BYTES = 1 << 16
#: Windows in a row at least, where its block has more; a piece's windows stay together.
WINDOWS = 1 << 15


class Grid:
    """Distances that follow from the length: the sliding window of anchors, and where a string's own anchors lie."""

    def __init__(self, length: int):
        if length < 10 * GRAM:
            raise ValueError(f"strings shorter than {10 * GRAM} bytes are not supported")
        self.length = length
        self.window = (length - GRAM) // 6
        # anchors of a string at p that its bytes alone decide lie in [p + first, p + last]
        self.first, self.last = self.window - 1, length - GRAM - self.window + 1
        self.margin = 2 * self.window + GRAM
        # whole phrases between the first and last of these anchors have this many bytes at least
        self.least = self.last - self.first - 2 * self.window
        # bytes around an anchor that all windows with this first anchor are inside of
        self.before, self.after = 2 * self.window, length - self.first

    def anchors(self, data: np.ndarray, borders: np.ndarray) -> np.ndarray:
        """Anchors of texts that lie end to end, ascending."""
        n = len(data) - GRAM + 1
        if n < self.window:
            return np.zeros(0, np.int64)
        halves = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
        grams = halves[:n] * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(32)
        grams += halves[8:8 + n]
        grams *= np.uint64(0xD6E8FEB86659FD93)
        low = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
        size = 1
        while 2 * size <= self.window:
            low, size = np.minimum(low[:-size], low[size:]), 2 * size
        if size < self.window:
            rest = self.window - size
            low = np.minimum(low[: len(low) - rest], low[rest:])
        # windows that lie in one text
        low = np.concatenate([low[a:max(a, b - GRAM - self.window + 2)] for a, b in zip(borders[:-1], borders[1:])])
        found = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
        # they ascend, as a window's last one goes on with the window
        return found[np.append(True, found[1:] != found[:-1])] if len(found) else found


def _borders(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)])


def _phrases(grid: Grid, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie end to end, their starts and anchors, the letters of the phrases that start there, and the
    borders of the texts in these; the last phrase goes to the text's end."""
    at = np.unique(np.concatenate([borders[:-1], grid.anchors(data, borders)]))
    hashes = hashing.Slices(data).of(at, np.append(at[1:], borders[-1]))
    return at, ((hashes & _LETTER) + np.uint64(1)).astype(np.int64), np.searchsorted(at, borders)


def _least_runs(grid: Grid, at: np.ndarray, letters: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the phrases from each on that have ``grid.least`` bytes together, and how many places of a text, from its
    first on, have such."""
    stop = np.searchsorted(at, at + grid.least)
    inside = stop < np.repeat(own[1:], np.diff(own))
    start = np.flatnonzero(inside)
    hashes = hashing.Slices(np.arange(len(at)), values=letters.view(np.uint64)).of(start, stop[start])
    return np.add.reduceat(inside, own[:-1], dtype=np.int64), hashes


def _covered(grid: Grid, at: np.ndarray, own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of the phrases that a string whose first own anchor is one of ``starts`` can contain."""
    stops = np.searchsorted(at, at[starts] + grid.last - grid.first)
    stops = np.minimum(stops, np.repeat(own[1:], np.diff(own))[starts])
    opened = np.bincount(starts, minlength=len(at) + 1) - np.bincount(stops, minlength=len(at) + 1)
    return np.flatnonzero(np.cumsum(opened)[:-1] > 0)


def _far(grid: Grid, sizes: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """How many letters from each on reach a window and a gap behind the first one's end, or the end of their string."""
    stops = _borders(sizes)
    upto = np.searchsorted(stops, stops[1:] + grid.length + grid.window)
    return np.minimum(upto, np.repeat(borders[1:], np.diff(borders))) - np.arange(len(sizes))


def _texts(batch: pa.RecordBatch, column: str):
    data, borders = flat(batch.column(batch.schema.get_field_index(column)))
    for row, (a, b) in enumerate(zip(borders[:-1], borders[1:])):
        yield row, data[a:b]


def _windows(grid: Grid, at: np.ndarray, reach: np.ndarray, off: np.ndarray, ends: np.ndarray, borders: np.ndarray):
    """For each anchor, the first and last start of windows whose first anchor it is and whose phrases may repeat as a
    whole; the last one is below the first where there is none.

    Runs with margins lie end to end from ``off`` on. ``at`` are their anchors, ``reach`` how many bytes of whole phrases
    from each occur elsewhere, ``borders`` the runs' borders in these, and ``ends`` the ends of their last phrases.
    """
    run = np.repeat(np.arange(len(ends)), np.diff(borders))
    before = np.append(np.iinfo(np.int64).min // 2, at[:-1])
    before[borders[:-1]] = before[0]
    low = np.maximum(np.maximum(before, at - grid.window) - grid.first + 1, off[run])
    # the first end of a phrase that is beyond what repeats
    stops = np.insert(at, borders[1:], ends)
    beyond = np.searchsorted(stops, at + reach, side="right")
    last = np.where(beyond > (borders[1:] + np.arange(len(ends)))[run], np.iinfo(np.int64).max, np.append(stops, 0)[beyond])
    high = np.minimum(np.minimum(at - grid.first, off[run + 1] - grid.length), last - grid.last - 1)
    return low, np.where(reach >= grid.least, high, low - 1)


def _pieces(off: np.ndarray, limit: int):
    """First and last border in ``off`` of neighbours that have at most ``limit`` together, or of one."""
    first = 0
    while first < len(off) - 1:
        stop = max(first + 1, int(np.searchsorted(off, off[first] + limit, side="right")) - 1)
        yield first, stop
        first = stop


def _sides(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of letters with the letters before and behind them, each letter with those that are there at all its places,
    0 in place of others, and where each place's letter lies in this."""
    keys, inverse, _ = distinct(lines[:1])
    order = np.argsort(inverse, kind="stable")
    heads = np.searchsorted(inverse[order], np.arange(keys.shape[1]))
    low, high = (f.reduceat(lines[1:, order], heads, axis=1) for f in (np.minimum, np.maximum))
    return np.concatenate([keys, np.where(low == high, low, np.uint64(0))]), inverse


def _spread(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of cores with a lowest and a highest surroundings and a mark, each core with these, and where each one lies in it."""
    keys, inverse, _ = distinct(lines[:1])
    order = np.argsort(inverse, kind="stable")
    heads = np.searchsorted(inverse[order], np.arange(keys.shape[1]))
    low = np.minimum.reduceat(lines[1, order], heads)
    high = np.maximum.reduceat(lines[2:, order], heads, axis=1)
    return np.concatenate([keys, low[None], high]), inverse


class Blocks:
    """Packs what belongs to many texts into rows for about ``BLOCK_BYTES`` of them, numbered apart in all tasks.

    A block's number and those behind it are free for the entries of its first column.
    """

    def __init__(self, names: list[str]):
        self.names, self.number = names, TaskContext.get().partitionId() << 33
        self.size, self.parts = 0, []

    def add(self, size: int, *parts: np.ndarray) -> None:
        self.size += size
        self.parts.append(parts)

    def take(self, least: int = 1):
        """The block, if it has ``least`` bytes."""
        if self.size < least:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([self.number]), *[pa.array([c.tobytes()], pa.binary()) for c in columns]], names=["block", *self.names]
        )
        self.number += max(1, len(columns[0]))
        self.size, self.parts = 0, []


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """``row``, ``spans``: for each text with repeats, sorted starts and ends of its bytes that lie in strings of ``length``
    bytes which also start elsewhere, as one array.

    ``texts`` has ``row`` (unique) and ``data`` (binary), and should be written rows, as it is read twice.
    """
    grid = Grid(length)
    long = texts.filter(F.octet_length("data") >= length)

    def packed(batch, row, names, columns):
        return pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("block")).slice(row, 1), *[pa.array([c.tobytes()], pa.binary()) for c in columns]],
            names=["block", *names],
        )

    def starts_of(batches):
        blocks = Blocks(["rows", "counts", "runs"])
        for batch in rows(batches, "data", PIECE_BYTES):
            data, borders = flat(batch.column(1))
            blocks.add(len(data), batch.column(0).to_numpy(), *_least_runs(grid, *_phrases(grid, data, borders)))
            yield from blocks.take(BLOCK_BYTES)
        yield from blocks.take()

    def run_keys(batch, row):
        return counted(numbers(batch, "runs", row, np.uint64)[None])

    phrases = once(long.mapInArrow(starts_of, "block long, rows binary, counts binary, runs binary"))
    common = once(meet(
        phrases.select("block", "runs"), "common", F.octet_length("runs"), lambda *at: run_keys(*at)[0], lambda lines: several(lines)[0]
    ), BLOCK_ROWS)

    def hits_of(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                hit = answers(batch, "common", row)[run_keys(batch, row)[1]]
                borders = _borders(numbers(batch, "counts", row))
                some = np.flatnonzero(np.diff(_borders(hit)[borders]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(numbers(batch, "rows", row)[some]),
                        pa.array([np.packbits(hit[borders[k]:borders[k + 1]]).tobytes() for k in some], pa.binary()),
                    ],
                    names=["row", "hits"],
                )

    hits = once(phrases.join(common, "block").mapInArrow(hits_of, "row long, hits binary"), BLOCK_ROWS)
    release(phrases, common)

    def cut_runs(batches):
        blocks = Blocks(["row", "start", "size", "count", "ends", "part", "at", "letters"])
        for batch in rows(batches, "data", PIECE_BYTES):
            data, borders = flat(batch.column(1))
            at, letters, own = _phrases(grid, data, borders)
            starts = [k + np.flatnonzero(np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8))) for k, x in zip(own, batch.column(2))]
            places = _covered(grid, at, own, np.concatenate(starts))
            owner = np.searchsorted(own, places, side="right") - 1
            heads = np.flatnonzero(np.append(True, (np.diff(places) != 1) | (np.diff(owner) != 0)))
            tails, owner = np.append(heads[1:], len(places)) - 1, owner[heads]
            end = np.append(at[1:], len(data))[places[tails]]
            left = np.maximum(borders[owner], at[places[heads]] - grid.margin)
            right = np.minimum(borders[owner + 1], end + grid.margin)
            count = tails - heads + 1
            blocks.add(
                int((right - left).sum()), batch.column(0).to_numpy()[owner], left - borders[owner], right - left, count, end - left,
                np.concatenate([data[a:b] for a, b in zip(left, right)]), at[places] - np.repeat(left, count), letters[places],
            )
            yield from blocks.take(RUN_BYTES)
        yield from blocks.take()

    # a block's number is that of its first run
    runs = once(long.join(hits.hint("merge"), "row").select("row", "data", "hits").mapInArrow(
        cut_runs,
        "block long, row binary, start binary, size binary, count binary, ends binary, part binary, at binary, letters binary",
    ))
    release(hits)

    def letter_keys(batch, row):
        letters = numbers(batch, "letters", row, np.uint64)
        borders = _borders(numbers(batch, "count", row))
        before, behind = np.zeros_like(letters), np.zeros_like(letters)
        before[1:], behind[:-1] = letters[:-1], letters[1:]
        before[borders[:-1]] = behind[borders[1:] - 1] = 0
        return _sides(np.stack([letters << np.uint64(2), before, behind]))

    def alone(lines):
        sides, inverse = _sides(lines)
        return ((sides[1] > 0) + 2 * (sides[2] > 0))[inverse]

    linked = once(meet(
        runs.select("block", "count", "letters"), "linked", 3 * F.octet_length("letters"), lambda *at: letter_keys(*at)[0], alone
    ), BLOCK_ROWS)

    def contract(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                link = answers(batch, "linked", row)[letter_keys(batch, row)[1]]
                borders = _borders(numbers(batch, "count", row))
                opens = np.ones(len(link), bool)
                opens[1:] = (link[:-1] < 2) | (link[1:] % 2 == 0)
                opens[borders[:-1]] = True
                heads, letters = np.flatnonzero(opens), numbers(batch, "letters", row)
                # equal ones in a row are one, as if they were as many everywhere
                heads = heads[np.append(True, letters[heads[1:]] != letters[heads[:-1]]) | np.isin(heads, borders)]
                at, ends, own = numbers(batch, "at", row), numbers(batch, "ends", row), np.searchsorted(heads, borders)
                sizes = np.append(at[heads[1:]], 0) - at[heads]
                sizes[own[1:] - 1] = ends - at[heads[own[1:] - 1]]
                again = np.add.reduceat(letters == np.repeat(letters[heads], np.diff(np.append(heads, len(at)))), heads) > 1
                block = batch.column(batch.schema.get_field_index("block"))[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block + np.arange(len(ends))), pa.array(np.full(len(ends), block)),
                        *[lists(x, own, pa.int64()) for x in (letters[heads], sizes, heads, again.astype(np.int64))],
                        pa.array(np.maximum.reduceat(_far(grid, sizes, own), own[:-1]), pa.int32()),
                    ],
                    names=["sid", "block", "letters", "sizes", "first", "least", "depth"],
                )

    strings = once(runs.select("block", "count", "ends", "at", "letters").join(linked, "block").mapInArrow(
        contract, "sid long, block long, letters array<long>, sizes array<long>, first array<long>, least array<long>, depth int"
    ), BLOCK_ROWS)
    release(linked)
    depth = strings.agg(F.max("depth")).first()[0]
    if depth is None:
        release(runs, strings)
        return texts.sparkSession.createDataFrame([], "row long, spans array<long>")
    ranks = suffix_ranks(strings.select("sid", "letters"), depth)

    def prefixes(batches):
        for batch in batches:
            letters, borders = flat_lists(batch.column(0))
            sizes, _ = flat_lists(batch.column(1))
            rank, _ = flat_lists(batch.column(2))
            far = _far(grid, sizes, borders)
            for a, b in _pieces(_borders(far), LETTERS):
                every = [letters[k:k + n].tobytes() for k, n in zip(range(a, b), far[a:b])]
                yield pa.RecordBatch.from_arrays([pa.array(rank[a:b]), pa.array(every, pa.binary())], names=["rank", "prefix"])

    ordered = strings.join(ranks, "sid")
    shared = once(common_prefixes(ordered.select("letters", "sizes", "ranks").mapInArrow(prefixes, "rank long, prefix binary")))
    place = ordered.select("sid", F.posexplode("ranks").alias("place", "rank")).join(shared, "rank")
    found = place.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("place", "shared"))).alias("r"))
    by_block = strings.join(found, "sid").groupBy("block").agg(F.array_sort(F.collect_list(
        F.struct("sid", "sizes", "first", "least", F.transform("r", lambda r: r["shared"]).alias("shared"))
    )).alias("strings"))

    def spread(batches):
        for batch in batches:
            index = batch.schema.get_field_index
            for row in range(batch.num_rows):
                own = batch.column(index("strings"))[row].values
                sizes, inner = flat_lists(own.field("sizes"))
                first, least, some = (flat_lists(own.field(c))[0] for c in ("first", "least", "shared"))
                at, stops = numbers(batch, "at", row), _borders(sizes)
                letter = np.searchsorted(first, np.arange(len(at)), side="right") - 1
                # a string repeats from inside a letter as far as from its start, and a loop as far as it goes
                some = np.maximum(some, least)
                upto = (stops[np.arange(len(sizes)) + some] - stops[:-1])[letter] - (at - at[first[letter]])
                upto[some[letter] == 0] = 0
                yield packed(batch, row, ["reach"], [upto])

    reach = once(runs.select("block", "count", "ends", "at").join(by_block, "block").mapInArrow(spread, "block long, reach binary"), BLOCK_ROWS)
    release(strings, ranks, shared)
    full = runs.drop("letters").join(reach, "block")

    def windows_of(batch, row):
        """Anchors of a block's runs, laid end to end, with the first and last window of each, and the borders of the runs."""
        off, borders = (_borders(numbers(batch, c, row)) for c in ("size", "count"))
        at = numbers(batch, "at", row) + np.repeat(off[:-1], np.diff(borders))
        low, high = _windows(grid, at, numbers(batch, "reach", row), off, numbers(batch, "ends", row) + off[:-1], borders)
        return at, low, high, off

    def contexts(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                at, low, high, off = windows_of(batch, row)
                data, wanted = numbers(batch, "part", row, np.uint8), np.flatnonzero(high >= low)
                own, run = at[wanted], np.searchsorted(off, at[wanted], side="right") - 1
                left, right = np.maximum(own - grid.before, off[run]), np.minimum(own + grid.after, off[run + 1])
                wide, upto = np.zeros((3, len(own)), np.uint64), np.minimum(own + grid.least, off[run + 1])
                for a, b in _pieces(off, PIECE_BYTES):
                    here = slice(*np.searchsorted(run, [a, b]))
                    for seed, (x, y) in enumerate(((own, upto), (left, right), (left, right)) if here.start < here.stop else ()):
                        wide[seed, here] = hashing.Slices(data[off[a]:off[b]], seed).of(x[here] - off[a], y[here] - off[a])
                core, *hashes = wide
                # the anchor's place in its surroundings is part of them
                hashes[0] = hashing.mix(hashes[0] + (own - left).astype(np.uint64))
                if len(wanted):
                    yield packed(batch, row, ["anchor", "c1", "c2", "core"], [wanted, *hashes, core >> np.uint64(1) << np.uint64(1)])

    around = once(full.mapInArrow(contexts, "block long, anchor binary, c1 binary, c2 binary, core binary"), BLOCK_ROWS)

    def class_keys(batch, row):
        return counted(np.stack([numbers(batch, c, row, np.uint64) for c in ("c1", "c2", "core")]))

    def class_of(lines):
        many, lead = several(lines)
        return many + 2 * lead

    classes = once(meet(
        around.drop("anchor"), "classes", 3 * F.octet_length("core"), lambda *at: class_keys(*at)[0], class_of
    ), BLOCK_ROWS)

    def classes_of(batch, row):
        """For each anchor, whether its surroundings occur twice, and whether it stands for them."""
        _, inverse, first = class_keys(batch, row)
        found = answers(batch, "classes", row)
        lead = np.zeros(len(inverse), bool)
        lead[first] = found >= 2
        return found[inverse] % 2 == 1, lead

    def core_keys(batch, row):
        twice, _ = classes_of(batch, row)
        core, c1 = numbers(batch, "core", row, np.uint64), numbers(batch, "c1", row, np.uint64)
        return _spread(np.stack([core, c1, c1, (~twice).astype(np.uint64)]))

    def uneven(lines):
        cores, inverse = _spread(lines)
        return ((cores[1] != cores[2]) & (cores[3] > 0))[inverse]

    # where all anchors with the same bytes behind them have the same surroundings, nothing is left to compare
    settled = around.join(classes, "block")
    mixed = once(meet(settled.drop("anchor"), "mixed", 4 * F.octet_length("core"), lambda *at: core_keys(*at)[0], uneven), BLOCK_ROWS)

    def choose(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                anchor, (twice, lead) = numbers(batch, "anchor", row), classes_of(batch, row)
                compared = answers(batch, "mixed", row)[core_keys(batch, row)[1]] > 0
                # surroundings that occur twice repeat with all their windows
                yield packed(batch, row, ["whole", "probes"], [anchor[twice], anchor[lead & compared]])

    chosen = once(settled.join(mixed, "block").mapInArrow(choose, "block long, whole binary, probes binary"), BLOCK_ROWS)
    release(around, classes, mixed)

    def hashed(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                _, low, high, off = windows_of(batch, row)
                probes, data = numbers(batch, "probes", row), numbers(batch, "part", row, np.uint8)
                block, low, high, parts = batch.column(batch.schema.get_field_index("block"))[row].as_py(), low[probes], high[probes], []
                for a, b in _pieces(off, PIECE_BYTES):
                    own = slice(*np.searchsorted(low, off[[a, b]]))
                    if own.start < own.stop:
                        ends = _borders(high[own] + 1 - low[own])
                        start = np.repeat(low[own] - ends[:-1], np.diff(ends)) + np.arange(ends[-1])
                        hashes = [hashing.Slices(data[off[a]:off[b]], seed).of(start - off[a], start - off[a] + length) for seed in (1, 2)]
                        # a row's number is that of its first run
                        number = number if parts else block + a
                        parts.append((start, *hashes))
                    if parts and (sum(len(p[0]) for p in parts) >= WINDOWS or b == len(off) - 1):
                        columns = [np.concatenate(c) for c in zip(*parts)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([number]), pa.array([block]), *[pa.array([c.tobytes()], pa.binary()) for c in columns]],
                            names=["block", "owner", "place", "w1", "w2"],
                        )
                        parts = []

    def window_keys(batch, row):
        return counted(np.stack([numbers(batch, c, row, np.uint64) for c in ("w1", "w2")]))

    windows = once(full.join(chosen.filter("octet_length(probes) > 0"), "block").mapInArrow(
        hashed, "block long, owner long, place binary, w1 binary, w2 binary"
    ), BLOCK_ROWS)
    again = once(meet(
        windows.drop("owner", "place"), "w1", 2 * F.octet_length("w1"), lambda *at: window_keys(*at)[0], lambda lines: several(lines)[0]
    ), BLOCK_ROWS)

    def repeated(batches):
        for batch in batches:
            owner = batch.column(batch.schema.get_field_index("owner"))
            for row in range(batch.num_rows):
                place = numbers(batch, "place", row)[answers(batch, "again", row)[window_keys(batch, row)[1]] > 0]
                heads = np.flatnonzero(np.append(True, np.diff(place) != 1))[:len(place)]
                tails = np.append(heads[1:], len(place))[:len(heads)] - 1
                if len(place):
                    yield pa.RecordBatch.from_arrays(
                        [owner.slice(row, 1), pa.array([np.stack([place[heads], place[tails]], axis=1).tobytes()], pa.binary())],
                        names=["block", "windows"],
                    )

    compared = windows.join(again.withColumnRenamed("w1", "again"), "block")
    twice = once(compared.mapInArrow(repeated, "block long, windows binary"), BLOCK_ROWS)
    release(windows, again)
    of_block = twice.groupBy("block").agg(F.collect_list("windows").alias("windows"))

    def spans(batches):
        for batch in batches:
            every = batch.column(batch.schema.get_field_index("windows"))
            for row in range(batch.num_rows):
                _, low, high, off = windows_of(batch, row)
                whole = numbers(batch, "whole", row)
                some = np.frombuffer(b"".join(every[row].as_py() or []), np.int64).reshape(-1, 2)
                run, pairs = merged(np.concatenate([np.stack([low[whole], high[whole]], axis=1), some]) + [0, length], off)
                used, first = np.unique(run, return_index=True)
                pairs += (numbers(batch, "start", row) - off[:-1])[run][:, None]
                if len(run):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(numbers(batch, "row", row)[used]),
                            lists(pairs.reshape(-1), 2 * np.append(first, len(run)), pa.int64()),
                        ],
                        names=["row", "spans"],
                    )

    by_run = full.drop("part").join(chosen, "block").join(of_block, "block", "left").mapInArrow(spans, "row long, spans array<long>")
    every = once(by_run.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans")), BLOCK_ROWS)
    release(runs, reach, chosen, twice)
    return every


def merged(pairs: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in runs that lie end to end from ``off`` on, overlapping or touching ones of a run as one, with their runs."""
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    run = np.searchsorted(off, pairs[:, 0], side="right") - 1
    upto = np.maximum.accumulate(pairs[:, 1])
    heads = np.flatnonzero(np.append(True, (pairs[1:, 0] > upto[:-1]) | (run[1:] != run[:-1]))[:len(run)])
    tails = np.append(heads[1:], len(run))[:len(heads)] - 1
    return run[heads], np.stack([pairs[heads, 0], upto[tails]], axis=1)


def united(spans: np.ndarray) -> np.ndarray:
    """Starts and ends in any order of pairs, overlapping or touching, as sorted pairs apart from each other."""
    pairs = spans.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    out = []
    for a, b in pairs.tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, np.int64).reshape(-1, 2)


def _inside_characters(pairs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The runs without the rests of characters that begin before them or end behind them."""
    begins = np.flatnonzero(np.append((data & 0xC0) != 0x80, True))
    first = begins[np.searchsorted(begins, pairs[:, 0])]
    last = begins[np.searchsorted(begins, pairs[:, 1], side="right") - 1]
    return np.stack([first, last], axis=1)[first < last]


@any_names
def remove_repeats(
    docs: DataFrame, text: str = "text", length: int = 400, keep: list[str] | None = None, with_text: bool = True,
    whole_characters: bool = False,
) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) plus ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and with
    ``with_text`` also ``kept_bytes``, the bytes that remain, and ``spans``, starts and ends of the removed runs.

    A byte is removed if it lies in a string of ``length`` bytes that also starts at another place, of this text or another;
    all are judged on the input, so every copy of a repeated string goes. With ``whole_characters``, UTF-8 characters
    that such a run cuts in two stay whole. Matches stay inside a text. A null text is
    empty; nothing is removed from it or from texts shorter than ``length``. Columns of ``docs`` with the new names are
    replaced; an empty table gives an empty result.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "spans"]
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    # a text that is carried is written once
    own = [] if carries(docs, text, carried) else [utf8(text).alias("_data")]
    read = "_data" if own else text
    marked = once(
        docs.select(*[F.col(f"`{c}`") for c in carried], *own).withColumn("_row", F.monotonically_increasing_id())
    )
    found = repeated_spans(marked.select(F.col("_row").alias("row"), utf8(read).alias("data")), length)
    names = new if with_text else new[:4]

    def apply(batches):
        for batch in rows(batches, read, SLICE_BYTES):
            every, borders = batch.column(batch.num_columns - 1), None
            every = every.fill_null([]) if every.null_count else every
            spans, borders = flat_lists(every)
            out = []
            for row, data in _texts(batch, read):
                pairs = united(spans[borders[row]:borders[row + 1]])
                if whole_characters:
                    pairs = _inside_characters(pairs, data)
                gone = np.zeros(len(data) + 1, np.int64)
                gone[pairs[:, 0]] += 1
                gone[pairs[:, 1]] -= 1
                kept = data[np.cumsum(gone[:-1]) == 0].tobytes()
                out.append((len(data), len(data) - len(kept), len(pairs), hashlib.sha256(kept).hexdigest(), kept, pairs.reshape(-1).tolist()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
            columns = [pa.array(c, k) for c, k, _ in zip(zip(*out), kinds, names)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], *columns], names=[*carried, *names])

    chosen = marked.join(found.hint("merge"), F.col("_row") == F.col("row"), "left").select(*carried, *(["_data"] if own else []), "spans")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema if f.name in carried)
    schema = fields + "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return chosen.mapInArrow(apply, schema + (", kept_bytes binary, spans array<long>" if with_text else ""))
