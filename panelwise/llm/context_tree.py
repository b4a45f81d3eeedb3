"""Text scores by context-tree weighting, beside a word unigram score.

Bytes are predicted bit by bit, from the highest bit down, so that each byte is eight binary decisions in a tree
of 255 nodes. Each decision has Krichevsky-Trofimov estimates for the contexts of 0 to ``depth`` bytes before it, and
the estimates of all depths are mixed by the weights that the training bytes give them. Contexts are real bytes and rows
of a table that grows with the corpus: it is grouped depth by depth, and joined to the contexts that blocks of texts ask for.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm import hashing
from panelwise.llm.common import any_names, flat, flat_lists, lists, once, places, release, rows, utf8

BLOCK_BYTES = 3 << 19
#: Bytes of a block's texts that a task takes apart at once.
SLICE_BYTES = 1 << 19
#: Values for blocks that a task holds until it writes a row for each block.
HELD_VALUES = 1 << 20
END = 0
_LEVEL = (
    "context long, bytes array<int>, n array<long>, nodes array<int>, total array<double>, ones array<double>, "
    "weighted array<double>, share array<double>"
)
_MIXED = "context long, bytes array<int>, nodes array<int>, stop array<double>, fixed array<double>, free array<double>"
_LOGS = "context long, bytes array<int>, logs array<float>"


def codes(data: np.ndarray, borders: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``context * 256 + byte`` of every byte of the lower-cased texts and of an end behind each; their borders.

    A context is the ``depth`` bytes before, the latest one lowest; before a text there are ends.
    """
    texts = len(borders) - 1
    # with ``depth`` ends before each text and one behind
    symbols = np.full(borders[-1] + texts * (depth + 1), END, np.uint8)
    inner = np.ones(len(symbols), bool)
    own = borders[:-1] + np.arange(texts) * (depth + 1)
    for k in range(depth):
        inner[own + k] = False
    behind = inner.copy()
    inner[borders[1:] + np.arange(1, texts + 1) * (depth + 1) - 1] = False
    symbols[inner] = hashing.LOWER[data]
    out = symbols.astype(np.int64)
    for back in range(1, depth + 1):
        out[back:] |= symbols[:-back].astype(np.int64) << (8 * back)
    return out[behind], borders + np.arange(texts + 1)


def _distinct(code: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, and each code's place among them; code and place are sorted as one number where they fit."""
    low = len(code).bit_length()
    if 8 * (depth + 1) + low > 63:
        return np.unique(code, return_inverse=True)
    both = code << low
    both |= np.arange(len(code))
    both.sort()
    order = both & ((1 << low) - 1)
    both >>= low
    new = np.diff(both, prepend=-1) != 0
    inverse = np.empty(len(code), np.int32)
    inverse[order] = np.cumsum(new) - 1
    return both[new], inverse


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after moving the argument above 8."""
    shift = np.zeros_like(x)
    x = x.copy()
    for _ in range(8):
        low = x < 8
        shift[low] += np.log(x[low])
        x[low] += 1
    r = 1 / (x * x)
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r / 1260)) / x - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def _decisions(row: np.ndarray, byte: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row * 256 + node`` of the binary decisions that lead to the bytes, ascending; how often they were met and gave one.

    A node is a byte's leading bits behind a one.
    """
    keys = np.concatenate([row * 256 + ((1 << bit) | (byte >> (8 - bit))) for bit in range(8)])
    ones = np.concatenate([n * ((byte >> (7 - bit)) & 1) for bit in range(8)])
    keys, inverse = np.unique(keys, return_inverse=True)
    return keys, np.bincount(inverse, np.tile(n, 8), len(keys)), np.bincount(inverse, ones, len(keys))


def _keyed(lists_: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """``row * 256 + value`` of the values of lists, and the lists' borders."""
    values, borders = flat_lists(lists_)
    return np.repeat(np.arange(len(lists_)), np.diff(borders)) * 256 + values, borders


def _level(context: pa.Array, pairs: np.ndarray, n: np.ndarray, below: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    """Rows of ``_LEVEL`` from the counts of ``row * 256 + byte`` and the summed logarithms of the next depth's nodes."""
    keys, total, ones = _decisions(pairs // 256, pairs % 256, n)
    weighted, share = _log_kt(total - ones, ones), np.ones(len(keys))
    if below:
        own = weighted + math.log(0.5)
        deeper = np.bincount(np.searchsorted(keys, below[0]), below[1], len(keys))
        weighted = np.logaddexp(own, deeper + math.log(0.5))
        share = np.exp(own - weighted)
    rows_ = np.arange(len(context) + 1)
    by_byte, by_node = np.searchsorted(pairs // 256, rows_), np.searchsorted(keys // 256, rows_)
    return pa.RecordBatch.from_arrays(
        [
            context, lists(pairs % 256, by_byte, pa.int32()), lists(n, by_byte, pa.int64()),
            lists(keys % 256, by_node, pa.int32()), lists(total, by_node, pa.float64()), lists(ones, by_node, pa.float64()),
            lists(weighted, by_node, pa.float64()), lists(share, by_node, pa.float64()),
        ],
        names=[f.split()[0] for f in _LEVEL.split(", ")],
    )


def _deepest(batches):
    for batch in batches:
        own = batch.column(1)
        structs = own.flatten()
        pairs = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy()) * 256 + structs.field("byte").to_numpy()
        order = np.argsort(pairs)
        yield _level(batch.column(0), pairs[order], structs.field("n").to_numpy()[order], None)


def _shorter(batches):
    """A context's counts and children's logarithms, from its longer contexts: at most 256 of at most 255 nodes."""
    for batch in batches:
        kids = batch.column(1)
        structs = kids.flatten()
        owner = np.repeat(np.arange(len(kids)), kids.value_lengths().to_numpy())
        flatten = lambda name: flat_lists(structs.field(name))
        byte, borders = flatten("bytes")
        pairs, inverse = np.unique(np.repeat(owner, np.diff(borders)) * 256 + byte, return_inverse=True)
        n = np.bincount(inverse, flatten("n")[0], len(pairs)).astype(np.int64)
        node, borders = flatten("nodes")
        below = np.repeat(owner, np.diff(borders)) * 256 + node, flatten("weighted")[0]
        yield _level(batch.column(0), pairs, n, below)


def _mixed(batches):
    """Each node's probability of a one where no longer context was seen (``stop``), the part of it that is fixed already
    (``fixed``), and the weight that is left to longer contexts (``free``); from a context's nodes and its parent's.
    """
    for batch in batches:
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        keys, borders = _keyed(column("nodes"))
        total, ones, share = (flat_lists(column(name))[0] for name in ("total", "ones", "share"))
        estimate = (ones + 0.5) / (total + 1.0)
        if "up_nodes" in batch.schema.names:
            at = np.searchsorted(_keyed(column("up_nodes"))[0], keys)
            stop, fixed, free = (flat_lists(column(f"up_{name}"))[0][at] for name in ("stop", "fixed", "free"))
        else:
            stop, fixed, free = estimate, np.zeros(len(keys)), np.ones(len(keys))
        stop = np.where(total > 0, fixed + free * estimate, stop)
        fixed, free = fixed + free * share * estimate, free * (1 - share)
        yield pa.RecordBatch.from_arrays(
            [
                column("context"), column("bytes"), column("nodes"),
                *[lists(x, borders, pa.float64()) for x in (stop, fixed, free)],
            ],
            names=[f.split()[0] for f in _MIXED.split(", ")],
        )


def _byte_logs(batches):
    """The logarithms of contexts' bytes, from rows of ``_MIXED``."""
    for batch in batches:
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        keys, _ = _keyed(column("nodes"))
        stop, _ = flat_lists(column("stop"))
        pairs, borders = _keyed(column("bytes"))
        row, byte, logs = pairs // 256, pairs % 256, np.zeros(len(pairs))
        for bit in range(8):
            p = stop[np.searchsorted(keys, row * 256 + ((1 << bit) | (byte >> (8 - bit))))]
            logs += np.log10(np.where((byte >> (7 - bit)) & 1, p, 1 - p))
        yield pa.RecordBatch.from_arrays(
            [column("context"), column("bytes"), lists(logs, borders, pa.float32())], names=["context", "bytes", "logs"]
        )


def _rated(batches):
    """``_mixed`` and ``_byte_logs`` of the deepest contexts in one Python worker, not two that run side by side."""
    return _byte_logs(_mixed(batches))


def model(counts: DataFrame, depth: int) -> DataFrame:
    """``context``, ``bytes``, ``logs``: the log10 probability of each byte of ``counts`` behind its context.

    ``counts`` has ``code`` (``context * 256 + byte``, each once) and ``n``, the times it was learned; a code with 0 is rated
    only. A cut is deleted once it has been read. Weights are those of stopping at a depth against going deeper, by the training bytes, from the deepest
    contexts up, one grouping a depth; the mixtures then go from the shortest context down, one join a depth. A
    context or decision that was never learned leaves the prediction to the shorter context. A group holds a
    context's bytes or its next longer contexts, at most 256 of either, whatever the corpus holds.
    """
    pair = F.struct((F.col("code") % 256).cast("int").alias("byte"), "n")
    deepest = counts.groupBy(F.shiftright("code", 8).alias("context")).agg(F.collect_list(pair).alias("pairs"))
    levels = [once(deepest.mapInArrow(_deepest, _LEVEL))]
    release(counts)
    for d in range(depth - 1, -1, -1):
        parent = (F.col("context") % 256**d).alias("context")
        kids = levels[0].groupBy(parent).agg(F.collect_list(F.struct("bytes", "n", "nodes", "weighted")).alias("kids"))
        levels.insert(0, once(kids.mapInArrow(_shorter, _LEVEL), batch_rows=200))
    mixed = levels[0].mapInArrow(_mixed, _MIXED)
    for d in range(1, depth + 1):
        up = mixed.select(F.col("context").alias("up"), *[F.col(c).alias(f"up_{c}") for c in ("nodes", "stop", "fixed", "free")])
        both = levels[d].join(up, F.col("context") % 256 ** (d - 1) == F.col("up"))
        mixed = both.mapInArrow(_mixed, _MIXED) if d < depth else both.mapInArrow(_rated, _LOGS)
    found = once(mixed)
    release(*levels)
    return found


def gather_counts(blocks: DataFrame, depth: int) -> DataFrame:
    """``code``, ``n``: all codes of blocks, and how often they occur in rows that are not held out.

    A task sums its blocks, half a million codes and more at a time, before anything is shuffled.
    """

    def summed(parts):
        found, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return found, np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(found)).astype(np.int64)

    def emit(found, n):
        for start in range(0, len(found), 1 << 16):
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[start:start + (1 << 16)]), pa.array(n[start:start + (1 << 16)])], names=["code", "n"]
            )

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for packed in batch.column("packed"):
                for part in _slices(_opened(packed.as_buffer())):
                    code, borders = codes(*flat(part.column(part.schema.get_field_index("_text"))), depth)
                    learned = ~part.column(part.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False)
                    code <<= 1
                    code |= np.repeat(learned, np.diff(borders))
                    code.sort()
                    starts = np.flatnonzero(np.diff(code >> 1, prepend=-1))
                    parts.append((code[starts] >> 1, np.add.reduceat(code & 1, starts) if len(starts) else starts))
                    held += len(starts)
                    if held > 1 << 20:
                        parts = [summed(parts)]
                        held = len(parts[0][0])
                        if held > 1 << 19:
                            yield from emit(*parts.pop())
                            held = 0
        if parts:
            yield from emit(*summed(parts))

    return blocks.select("packed").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _asked(code: np.ndarray, block: int):
    """A block's distinct codes, ascending, as one row per context with its bytes."""
    starts = np.flatnonzero(np.diff(code >> 8, prepend=-1))
    borders = np.append(starts, len(code)).astype(np.int32)
    for at in range(0, len(starts), 1 << 16):
        some = borders[at:at + (1 << 16) + 1]
        own = (code[some[0]:some[-1]] & 255).astype(np.uint8)
        bytes_ = pa.Array.from_buffers(pa.binary(), len(some) - 1, [None, pa.py_buffer(some - some[0]), pa.py_buffer(own)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(code[some[:-1]] >> 8), pa.array(np.full(len(some) - 1, block)), pa.array(some[:-1]), bytes_],
            names=["context", "block", "place", "asked"],
        )


def _by_block(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct blocks, the borders of their values, and the values' columns in order of block; block is the first column."""
    columns = [np.concatenate(c) for c in zip(*held)]
    order = np.argsort(columns[0], kind="stable")
    block = columns[0][order]
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    return block[starts], np.append(starts, len(block)), [c[order] for c in columns[1:]]


def _held(found, emit):
    """What ``emit`` makes of the tuples of arrays in ``found``, some ``HELD_VALUES`` at a time, however short each is."""
    held, n = [], 0
    for part in found:
        held.append(part)
        n += len(part[0])
        if n >= HELD_VALUES:
            yield emit(held)
            held, n = [], 0
    if n:
        yield emit(held)


def _answers(batches):
    """The logarithms of the asked bytes and their places, a row for each block that a task meets."""

    def found():
        for batch in batches:
            keys, _ = _keyed(batch.column(3))
            logs, _ = flat_lists(batch.column(4))
            own, borders = flat(batch.column(2))
            times = np.diff(borders)
            wanted = np.repeat(np.arange(batch.num_rows), times) * 256 + own
            place = np.repeat(batch.column(1).to_numpy(), times) + places(borders)
            yield np.repeat(batch.column(0).to_numpy(), times), place.astype(np.int32), logs[np.searchsorted(keys, wanted)]

    def emit(held):
        block, borders, (place, logs) = _by_block(held)
        return pa.RecordBatch.from_arrays(
            [pa.array(block), lists(place, borders, pa.int32()), lists(logs, borders, pa.float32())],
            names=["block", "place", "logs"],
        )

    yield from _held(found(), emit)


def _word_answers(batches):
    """The corpus counts of words and their places, a row for each block that a task meets, with the words new there."""

    def emit(held):
        block, borders, (place, c, first) = _by_block(held)
        new = np.add.reduceat((first & (c > 0)).astype(np.int64), borders[:-1])
        return pa.RecordBatch.from_arrays(
            [pa.array(block), lists(place, borders, pa.int32()), lists(c, borders, pa.int64()), pa.array(new)],
            names=["block", "place", "c", "new_words"],
        )

    yield from _held(([c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches), emit)


def block_logs(blocks: DataFrame, depth: int) -> DataFrame:
    """``block``, ``logs``: the logarithms of a block's distinct codes, as lists with their places."""

    def ask(batches):
        for batch in batches:
            for packed, block in zip(batch.column("packed"), batch.column("block").to_pylist()):
                found = []
                for part in _slices(_opened(packed.as_buffer())):
                    code, _ = codes(*flat(part.column(part.schema.get_field_index("_text"))), depth)
                    code.sort()
                    found.append(code[np.diff(code, prepend=-1) != 0])
                yield from _asked(np.unique(np.concatenate(found)), block)

    counts = once(gather_counts(blocks, depth))
    table = model(counts, depth)
    asked = blocks.select("packed", "block").mapInArrow(ask, "context long, block long, place int, asked binary")
    answers = asked.join(table, "context").select("block", "place", "asked", "bytes", "logs").mapInArrow(
        _answers, "block long, place array<int>, logs array<float>"
    )
    found = once(answers.groupBy("block").agg(F.collect_list(F.struct("place", "logs")).alias("logs")), batch_rows=10_000)
    release(table)
    return found


def _packed(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _opened(data) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(data)))


def _slices(block: pa.RecordBatch):
    """A block cut into parts of at most ``SLICE_BYTES``, or one longer text."""
    if block.num_rows:
        yield from rows([block], "_text", SLICE_BYTES)


def _blocks(batches):
    """Batches joined or cut to between one and two times ``BLOCK_BYTES``, or one longer row."""
    waiting, held = [], 0
    for batch in rows(batches, "_text", BLOCK_BYTES):
        waiting.append(batch)
        held += batch.nbytes
        if held >= BLOCK_BYTES:
            yield pa.concat_batches(waiting)
            waiting, held = [], 0
    if waiting:
        yield pa.concat_batches(waiting)


def _word_hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block's texts, and the number of each one's text."""
    found, owners, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for part in _slices(batch):
        data, borders = flat(part.column(part.schema.get_field_index("_text")))
        data = hashing.LOWER[data]
        start, stop, owner = hashing.words(data, borders)
        found.append(hashing.Slices(data).of(start, stop).view(np.int64))
        owners.append(owner + texts)
        texts += part.num_rows
    return np.concatenate(found), np.concatenate(owners)


@any_names
def score(
    docs: DataFrame, text: str = "text", held_out: Column | None = None, keep: list[str] | None = None,
    depth: int = 4,
) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) plus ``held_out``, ``n_bytes``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score`` and ``bits_per_byte``.

    Rows where ``held_out`` is true are scored but not learned from; null counts as false, and by default all rows
    are learned from. Texts are lower-cased in A-Z; a null text is empty. ``score`` is the log10 probability of the
    text's bytes and the end behind them, ``bits_per_byte`` the same as code length by byte. ``base_score`` is
    the sum over words and one end of ``log10((c + 1) / (N + 1 * (V + 1)))``; ``c`` is the token's training count, ``N``
    all training tokens, ``V`` the distinct ones. With nothing to learn from, ``N`` and ``V`` are 0.

    Texts are packed into blocks of about ``BLOCK_BYTES``. A block sends each of its distinct words and contexts once, whatever
    its documents repeat, and gets the corpus counts and probabilities back; a very frequent word or context thus has one row
    per block. Words meet by 64-bit hash, contexts of ``depth`` bytes (at most 6) as they are. Columns of ``docs`` with the new names are replaced; an empty table gives an empty result.
    """
    if not 1 <= depth <= 6:
        raise ValueError("a context has 1 to 6 bytes")
    new = ["held_out", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    chosen = docs.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(False)).alias("held_out"), utf8(text).alias("_text"),
    )

    def block_up(batches):
        for batch in _blocks(batches):
            learned = batch.filter(pa.compute.invert(batch.column("held_out")))
            n = len(_word_hashes(learned)[0]) + learned.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([_packed(batch)], pa.binary()), pa.array([n], pa.int64()), pa.array([learned.num_rows], pa.int64())],
                names=["packed", "train_tokens", "train_docs"],
            )

    blocks = once(
        chosen.mapInArrow(block_up, "packed binary, train_tokens long, train_docs long")
        .withColumn("block", F.monotonically_increasing_id())
    )

    logs = block_logs(blocks, depth)

    def block_words(batches):
        for batch in batches:
            for packed, block in zip(batch.column("packed"), batch.column("block").to_pylist()):
                part = _opened(packed.as_buffer())
                hashes, owner = _word_hashes(part)
                held = part.column(part.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False)
                distinct, inverse = np.unique(hashes, return_inverse=True)
                times = np.bincount(inverse[~held[owner]], minlength=len(distinct))
                for at in range(0, len(distinct), 1 << 16):
                    stop = min(at + (1 << 16), len(distinct))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(distinct[at:stop]), pa.array(np.full(stop - at, block)),
                            pa.array(np.arange(at, stop), pa.int32()), pa.array(times[at:stop], pa.int32()),
                        ],
                        names=["word", "block", "place", "times"],
                    )

    word_rows = blocks.select("packed", "block").mapInArrow(block_words, "word long, block long, place int, times int")
    same = Window.partitionBy("word")
    counted = word_rows.select(
        "block", "place", F.sum("times").over(same).alias("c"), (F.min("block").over(same) == F.col("block")).alias("first")
    )
    by_block = once(
        counted.mapInArrow(_word_answers, "block long, place array<int>, c array<long>, new_words long").groupBy("block").agg(
            F.collect_list(F.struct("place", "c")).alias("counts"), F.sum("new_words").alias("new_words")
        ),
        batch_rows=10_000,
    )
    totals = blocks.agg(F.sum("train_tokens").alias("n"), F.sum("train_docs").alias("d")).first()
    n_train, n_ends = totals["n"] or 0, totals["d"] or 0
    v_train = (by_block.agg(F.sum("new_words")).first()[0] or 0) + (n_ends > 0)
    floor = math.log10(max(n_train + v_train + 1, 1))

    def rate(batches):
        for batch in batches:
            for packed, pairs, answers in zip(*batch.columns):
                part = _opened(packed.as_buffer())
                hashes, owner = _word_hashes(part)
                distinct, inverse = np.unique(hashes, return_inverse=True)
                c = np.zeros(len(distinct))
                if pairs.is_valid and len(distinct):
                    c[flat_lists(pairs.values.field("place"))[0]] = flat_lists(pairs.values.field("c"))[0]
                c, texts = c[inverse], part.num_rows
                tokens = np.bincount(owner, minlength=texts) + 1
                base = np.bincount(owner, np.log10(c + 1), texts) + math.log10(n_ends + 1) - tokens * floor
                known = np.bincount(owner[c > 0], minlength=texts) + (n_ends > 0)
                parts = []
                for piece in _slices(part):
                    code, borders = codes(*flat(piece.column(piece.schema.get_field_index("_text"))), depth)
                    parts.append((*_distinct(code, depth), borders))
                every = np.unique(np.concatenate([p[0] for p in parts]))
                own = np.zeros(len(every))
                own[flat_lists(answers.values.field("place"))[0]] = flat_lists(answers.values.field("logs"))[0]
                upto, rated, size = 0.0, [], []
                for distinct, inverse, borders in parts:
                    total = np.cumsum(np.concatenate([[upto], own[np.searchsorted(every, distinct)][inverse]]))
                    rated.append(total[borders[1:]] - total[borders[:-1]])
                    size.append(np.diff(borders) - 1)
                    upto = total[-1]
                rated, size = np.concatenate(rated), np.concatenate(size)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(k) for k in range(len(kept) + 1)], pa.array(size), pa.array(tokens), pa.array(known),
                        pa.array(np.full(texts, n_train)), pa.array(base), pa.array(rated),
                        pa.array(-rated / math.log10(2) / (size + 1)),
                    ],
                    names=[*kept, *new],
                )

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema if f.name in kept)
    schema = fields + (
        "held_out boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double, bits_per_byte double"
    )
    answered = blocks.join(logs, "block").join(by_block, "block", "left").select("packed", "counts", "logs")
    rated = answered.mapInArrow(rate, schema)
    if "void" in fields or "interval" in fields:
        # carried columns that Parquet does not hold
        return rated
    # a row is a block with its answers, so few of them make a batch
    scored = once(rated, batch_rows=2)
    release(blocks, logs, by_block)
    return scored
