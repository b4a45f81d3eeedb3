"""Mixture-controlled packing: source queues fill every window to target proportions, without padding.

Deficit round-robin in closed form. A queue with weight ``p`` and ``N`` tokens has given ``floor(min(N, p * v))``
tokens at virtual time ``v``; window ``w`` ends at the time when all queues together have given ``w`` windows
of tokens. What the floor holds back is the queue's deficit: it is carried to the next window, and since it
depends on ``w`` alone, no state passes between windows or partitions. When a queue runs dry, the others
share its place in proportion to their weights. A token's place in its queue thus fixes its window, sequence
and offset, and every document is laid out by itself.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm import tokenizing
from panelwise.llm.common import any_names, once, rows, utf8

REST = 0


class Layout:
    """Places of queue tokens: ``sizes`` and ``weights`` by queue, ``window`` and ``length`` in tokens."""

    def __init__(self, sizes: list[int], weights: list[float], window: int, length: int):
        self.sizes, self.window, self.length = np.array(sizes, np.int64), window, length
        self.weights = np.array(weights, float)
        self.total = int(self.sizes.sum())
        self.windows = -(-self.total // window)
        dry = np.where(self.sizes > 0, self.sizes / self.weights, 0.0)
        self._times = np.unique(np.concatenate([[0.0], dry]))
        # by prefix sums over the queues in the order in which they run dry, as there may be very many
        order = np.argsort(dry, kind="stable")
        emptied = np.concatenate([[0], np.cumsum(self.sizes[order])])
        open_weights = np.append(np.cumsum(self.weights[order][::-1])[::-1], 0.0)
        done = np.searchsorted(dry[order], self._times, side="right")
        self._given = emptied[done] + self._times * open_weights[done]
        # at most 32 MB
        self._counts = functools.lru_cache(int(min(4096, max(2, (4 << 20) // len(self.sizes)))))(self._count)
        # the rest behind the last full sequence, as sequences whose lengths are powers of two
        full, rest = divmod(self.total, length)
        powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        self._tail = full * length + np.concatenate([[0], np.cumsum(powers)]).astype(np.int64)

    def _count(self, w: int) -> np.ndarray:
        """Tokens that every queue has given at the end of window ``w``, windows counted from 1."""
        if w >= self.windows:
            return self.sizes
        v = np.interp(w * self.window, self._given, self._times)
        return np.minimum(self.sizes, np.floor(self.weights * v).astype(np.int64))

    def window_of(self, queue: int, place: int) -> int:
        """The window, counted from 1, that gets the queue's token number ``place``."""
        v = place / self.weights[queue]
        w = int(np.interp(v, self._times, self._given) / self.window) + 1
        w = min(max(w, 1), self.windows)
        while w > 1 and self._counts(w - 1)[queue] > place:
            w -= 1
        while self._counts(w)[queue] <= place:
            w += 1
        return w

    def pieces(self, queue: int, start: int, length: int):
        """``(start in the document, length, sequence, offset)`` of a document's tokens."""
        at = start
        while at < start + length:
            w = self.window_of(queue, at)
            before, upto = self._counts(w - 1) if w > 1 else np.zeros_like(self.sizes), self._counts(w)
            stop = min(start + length, int(upto[queue]))
            place = int(before.sum() + (upto - before)[:queue].sum() + at - before[queue])
            while at < stop:
                sequence, offset, room = self._sequence(place)
                n = min(stop - at, room)
                yield at - start, n, sequence, offset
                at, place = at + n, place + n

    def _sequence(self, place: int) -> tuple[int, int, int]:
        if place < self._tail[0]:
            return place // self.length, place % self.length, self.length - place % self.length
        k = int(np.searchsorted(self._tail, place, side="right")) - 1
        return int(self._tail[0] // self.length + k), int(place - self._tail[k]), int(self._tail[k + 1] - place)


@any_names
def pack(
    docs: DataFrame, text: str = "text", by: str = "source", vocabulary: str = "word_bpe_49k.json", end: int = 2,
    length: int = 4096, window_sequences: int = 16, queues: int | None = None, targets: dict[str, float] | None = None,
    keep: list[str] | None = None, with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` tokens: the columns of ``docs`` (or ``keep``), ``start``,
    ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` and, with ``with_ids``, ``ids`` (binary,
    little-endian unsigned 32-bit numbers).

    A document is its text's ids followed by ``end``; a null text is empty, so its only token is ``end``. Every
    value of ``by`` has a queue, and so has null; if a caller sets ``queues``, only that many values with most
    bytes have one (ties: by name), all others share null's, and a target named for another value is an error.
    Names and sizes of the queues go to the driver and to all tasks, and each window needs a number per queue.
    Windows of ``window_sequences`` sequences hold the queues in the proportions of ``targets`` (weights by value
    of ``by``, 1 where not named), or without it in those of the corpus, which end together. Only the last
    tokens, fewer than ``length``, form shorter sequences, with lengths that are powers of two; nothing is padded.
    Order inside a queue is the order of the input's partitions. The ids are written once and read once;
    rows of a large queue stay where they are, as a queue's places are sums per partition. An empty table gives
    an empty result; columns of ``docs`` with the new names are replaced.
    """
    path = tokenizing.path_of(vocabulary)
    new = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    named = F.col(f"`{by}`").cast("string")
    # a row per queue
    largest = (
        docs.filter(named.isNotNull()).groupBy(named.alias("name"))
        .agg(F.sum(F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0))).alias("bytes"))
        .orderBy(F.desc("bytes"), "name")
    )
    largest = (largest if queues is None else largest.limit(queues)).collect()
    number = {r["name"]: k + 1 for k, r in enumerate(largest)}
    unknown = sorted(str(n) for n in set(targets or ()) - {None, *number})
    if queues is not None and unknown:
        raise ValueError(f"targets without a queue: {', '.join(unknown)}")
    narrow = tokenizing.library(path).get_vocab_size() <= 1 << 16 and end < 1 << 16
    kind = "<u2" if narrow else "<u4"

    def encode(batches):
        words, given, part = tokenizing.words_of(path), {}, TaskContext.get().partitionId()
        for batch in rows(batches, "_text", 1 << 20):
            ids, sizes, lines, before = [], [], [], []
            texts = [tokenizing.text_of(t.as_py()) for t in batch.column("_text")]
            for raw, name in zip(words.ids(texts), batch.column("_by").to_pylist()):
                queue = number.get(name, REST)
                ids.append(np.append(raw, end).astype(kind).tobytes())
                sizes.append(len(raw) + 1)
                lines.append(queue)
                before.append(given.get(queue, 0))
                given[queue] = before[-1] + sizes[-1]
            columns = [batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [
                    *columns, pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lines, pa.int32()),
                    pa.array([part] * len(ids), pa.int32()), pa.array(before, pa.int64()),
                ],
                names=[*kept, "_ids", "doc_tokens", "_queue", "_part", "_before"],
            )

    chosen = docs.select(*[F.col(f"`{c}`") for c in kept], utf8(text).alias("_text"), named.alias("_by"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema if f.name not in ("_text", "_by"))
    encoded = once(
        chosen.mapInArrow(encode, f"{fields}_ids binary, doc_tokens long, _queue int, _part int, _before long")
    )
    sums = encoded.groupBy("_queue", "_part").agg(F.sum("doc_tokens").alias("_tokens"))
    earlier = Window.partitionBy("_queue").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = once(sums.withColumn("_start", F.coalesce(F.sum("_tokens").over(earlier), F.lit(0))))
    # a row per queue
    sizes = {r["_queue"]: r["n"] for r in starts.groupBy("_queue").agg(F.sum("_tokens").alias("n")).collect()}
    tokens = [sizes.get(q, 0) for q in range(len(number) + 1)]
    names = [None, *number]
    weights = [float(t or 1) for t in tokens] if targets is None else [float(targets.get(n, 1.0)) for n in names]
    window = window_sequences * length

    def place(batches):
        layout = Layout(tokens, weights, window, length)
        for batch in rows(batches, "_ids"):
            at = {n: batch.column(batch.schema.get_field_index(n)) for n in ("_ids", "_queue", "_before", "_start")}
            owner, out, parts = [], [], []
            where = zip(at["_ids"], at["_queue"].to_pylist(), at["_before"].to_pylist(), at["_start"].to_pylist())
            for row, (ids, queue, before, start) in enumerate(where):
                ids = np.frombuffer(ids.as_py(), kind).astype("<u4")
                for first, n, sequence, offset in layout.pieces(queue, start + before, len(ids)):
                    piece = ids[first:first + n].tobytes()
                    owner.append(row)
                    out.append((first, n, zlib.crc32(piece), len(ids), sequence, offset))
                    parts.append(piece if with_ids else None)
            taken = batch.select(kept).take(pa.array(owner, pa.int64()))
            columns = [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 6)]
            if with_ids:
                columns.append(pa.array(parts, pa.binary()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, *columns], names=[*kept, *(new if with_ids else new[:-1])]
            )

    placed = encoded.join(starts.select("_queue", "_part", "_start"), ["_queue", "_part"])
    schema = fields + ", ".join(f"{n} long" for n in new[:-1]) + (", ids binary" if with_ids else "")
    return placed.select(*kept, "_ids", "_queue", "_before", "_start").mapInArrow(place, schema)
