"""Exact fast paths to public tokenizers: pieces of a text are encoded once per task and remembered.

Both tokenizers of this module split a text into pieces that are encoded independently of each other, so a
text's ids are its pieces' ids joined. Texts with characters outside a plain range, or with the special
tokens' opening bracket, go through the library as a whole.
"""

from __future__ import annotations

import functools
import hashlib
import os

import numpy as np
import regex

from panelwise.llm import hashing

#: The splitting patterns of the two vocabulary files.
BYTE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
WORD_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts of these characters have one reading in all Unicode versions, need no normalising and lower one to one.
_UNUSUAL = regex.compile(r"[^\x09\x0A\x0D\x20-\x7E¡-įı-ňŊ-ž‐-‧€]|<\|")
REMEMBERED, LONGEST = 400_000, 64


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def library(path: str):
    """The library's tokenizer, without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.cache
def digest_of(path: str) -> str:
    """Digest of a vocabulary file: the tokenizer's version."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def plain(text: str) -> bool:
    return _UNUSUAL.search(text) is None


def text_of(data: bytes) -> str:
    """A text column's bytes as text; bytes that are no UTF-8 become replacement characters."""
    return data.decode("utf-8", "replace")


class Pieces:
    """Ids of texts as little-endian numbers, piece by piece, remembering short pieces.

    The memory is emptied when it holds ``REMEMBERED`` pieces; that costs time and changes no result.
    """

    def __init__(self, path: str, words: bool, encode=None):
        self._library = library(path)
        self._split = (WORD_PIECES if words else BYTE_PIECES).findall
        self._words = words
        self._encode = encode or self._by_library
        self._known: dict[str, bytes] = {}

    def _by_library(self, pieces: list[str]) -> list[bytes]:
        found = self._library.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def whole(self, text: str) -> bytes:
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if not plain(text):
            return self.whole(text)
        return self.join(self._split(text.lower() if self._words else text))

    def join(self, pieces: list[str]) -> bytes:
        known = self._known
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        missing = list(dict.fromkeys(p for p in pieces if p not in known))
        known.update(zip(missing, self._encode(missing)))
        out = b"".join(map(known.__getitem__, pieces))
        for piece in missing:
            if len(piece) > LONGEST:
                del known[piece]
        return out


_CONTRACTED = regex.compile(r"'(?:s|t|re|ve|m|ll|d)", regex.IGNORECASE)
_PLAIN_END = 0x2100


@functools.cache
def _plain_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: kind (0 white space, 1 letter, 2 number, 3 other, 4 not plain), lower case, and a random number."""
    kinds, lower = np.full(_PLAIN_END, 3, np.uint8), np.arange(_PLAIN_END, dtype=np.uint32)
    for k, pattern in ((0, r"\s"), (1, r"\p{L}"), (2, r"\p{N}")):
        found = regex.compile(pattern)
        kinds[[c for c in range(_PLAIN_END) if found.fullmatch(chr(c))]] = k
    kinds[[c for c in range(_PLAIN_END) if not plain(chr(c))]] = 4
    for c in range(_PLAIN_END):
        low = chr(c).lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return kinds, lower, hashing.mix(np.arange(_PLAIN_END, dtype=np.uint64) + np.uint64(77))


class Words:
    """Ids of many texts at once under the word vocabulary.

    Plain texts without contractions are split by kinds of characters, all texts in one array. Each distinct piece of
    a call is looked up once, by a 64-bit hash, and encoded by the library where it is new; the memory of
    pieces is emptied when it holds ``REMEMBERED`` of them. Other texts go through ``Pieces``.
    """

    def __init__(self, path: str):
        self._pieces = Pieces(path, words=True)
        self._ends = None
        self._reset()

    def _reset(self):
        self._known: dict[int, int] = {}
        self._borders, self._ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        fast = self._fast(texts)
        out = [None if f else np.frombuffer(self._pieces.ids(t), "<u4") for t, f in zip(texts, fast)]
        chosen = [k for k, f in enumerate(fast) if f]
        if chosen:
            for k, ids in zip(chosen, self._split([texts[k] for k in chosen])):
                out[k] = ids
        return out

    def _fast(self, texts: list[str]) -> list[bool]:
        """Whether a text is plain and has no contraction."""
        kinds = _plain_tables()[0]
        points = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        odd = np.flatnonzero(kinds[np.minimum(points, _PLAIN_END - 1)] == 4)
        border = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        usual = np.ones(len(texts), bool)
        usual[np.searchsorted(border, odd, side="right") - 1] = False
        return [bool(u) and "<|" not in t and not ("'" in t and _CONTRACTED.search(t)) for u, t in zip(usual, texts)]

    def _encode(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces, many of them joined to a text; the last token of a piece is one that ends a word."""
        library, size = self._pieces._library, 256
        if self._ends is None:
            vocabulary = library.get_vocab(with_added_tokens=False)
            self._ends = np.zeros(max(vocabulary.values()) + 3, bool)
            self._ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        parts = [pieces[k:k + size] for k in range(0, len(pieces), size)]
        out = []
        for part, e in zip(parts, library.encode_batch_fast([" ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self._ends[ids]) + 1
            if len(ends) == len(part) and (not len(ends) or ends[-1] == len(ids)):
                out += np.split(ids, ends[:-1])
            else:
                out += [np.array(library.encode(x, add_special_tokens=False).ids, np.uint32) for x in part]
        return out

    def _split(self, texts: list[str]) -> list[np.ndarray]:
        kinds, lower, random = _plain_tables()
        whole = " ".join(texts)
        points = lower[np.frombuffer(whole.encode("utf-32-le"), "<u4")]
        kind = kinds[points]
        opens = kind != 0
        opens[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        start = np.flatnonzero(opens)
        ends = np.append(np.flatnonzero((kind[1:] != kind[:-1]) | (kind[1:] == 2)) + 1, len(kind))
        stop = ends[np.searchsorted(ends, start, side="right")]
        hashes = hashing.Slices(points, values=random).of(start, stop)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._known) > REMEMBERED:
            self._reset()
        known = self._known
        number = np.array([known.get(h, -1) for h in distinct.tolist()], np.int64)
        new = np.flatnonzero(number < 0)
        if len(new):
            low = whole.lower()
            ids = self._encode([low[a:b] for a, b in zip(start[first[new]].tolist(), stop[first[new]].tolist())])
            number[new] = len(known) + np.arange(len(new))
            known.update(zip(distinct[new].tolist(), number[new].tolist()))
            self._borders = np.append(self._borders, self._borders[-1] + np.cumsum([len(i) for i in ids]))
            self._ids = np.concatenate([self._ids, *ids])
        number = number[inverse]
        sizes = self._borders[number + 1] - self._borders[number]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self._ids[np.arange(upto[-1]) + np.repeat(self._borders[number] - upto[:-1], sizes)]
        border = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        at = upto[np.searchsorted(start, border)]
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]


@functools.cache
def words_of(path: str) -> Words:
    return Words(path)


def pieces_of(path: str, words: bool) -> Pieces:
    return _pieces(path, words)


@functools.cache
def _pieces(path: str, words: bool) -> Pieces:
    return Pieces(path, words)
