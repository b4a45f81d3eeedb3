"""Vectorised 64-bit hashes of words, lines, phrases and windows of many texts at once.

A running sum of ``table[byte] * base ** position`` over the whole buffer gives the hash of any slice as a
difference, shifted back by the inverse power. All arithmetic is modulo 2**64; a final mix spreads the bits.
The hashes depend on the bytes alone, so they agree between tasks, machines and runs.
"""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}
#: ASCII white space that separates words: space, and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["up"], _tables["down"]


@functools.cache
def _letters(seed: int) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64) + np.uint64((1 + 1000 * seed) * _BASE % (1 << 64)))


class Slices:
    """Hashes of slices of one buffer; ``values`` are the numbers of its elements, for bytes given by the seed."""

    def __init__(self, data: np.ndarray, seed: int = 0, values: np.ndarray | None = None):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_letters(seed) if values is None else values)[data] * up[: len(data)], out=self._sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        raw = (self._sums[stop] - self._sums[start]) * self._down[start]
        return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word, texts being ``data[borders[i]:borders[i + 1]]``."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~SPACE[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = borders[:-1][borders[:-1] < borders[1:]]
    opens[first] = inside[first]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[borders[1:][borders[:-1] < borders[1:]] - 1] = inside[borders[1:][borders[:-1] < borders[1:]] - 1]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(borders, start, side="right") - 1


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` neighbouring hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[k:k + n]
    return mix(out)


def within(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between owners."""
    return mix(hashes + mix(owner.astype(np.uint64)))
