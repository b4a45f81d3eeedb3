"""Exact byte-pair encoding in linear time by backtracking over longest matches, and decoding by offsets.

An Aho-Corasick automaton over the vocabulary finds, for every position of a piece, the longest token that
starts there. The encoder appends such a token if it may follow the one before; if not it tries the token's
next shorter prefix token, and at the end of these steps back. Two tokens may stand side by side when
encoding their joined bytes by merges gives just these two: this is read off the merge tables by walking down
the border of both tokens, and each answer is kept in the compatibility table. A piece position that was left
once is never tried again, so the work is linear in the piece.
"""

from __future__ import annotations

import functools
import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm import tokenizing
from panelwise.llm.common import any_names, rows, utf8


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable bytes stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


class Backtracking:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        letters = byte_letters()
        model = data["model"]
        self.tokens = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ids = {b: i for i, b in self.tokens.items()}
        join = lambda m: m if isinstance(m, list) else m.split(" ")
        parts = [[ids[bytes(letters[c] for c in s)] for s in join(m)] for m in model["merges"]]
        self._rank = {tuple(p): r for r, p in enumerate(parts)}
        self._whole = {tuple(p): ids[self.tokens[p[0]] + self.tokens[p[1]]] for p in parts}
        self._made = {}  # token: the merge that makes it, by rank
        for r, p in enumerate(parts):
            self._made.setdefault(self._whole[tuple(p)], (r, *p))
        self._automaton = ahocorasick.Automaton()
        for i, b in self.tokens.items():
            self._automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self._automaton.make_automaton()
        self._length = {i: len(b) for i, b in self.tokens.items()}
        self._ids = ids
        self._shorter: dict[int, int] = {}
        self._beside: dict[tuple[int, int], bool] = {}
        size = max([*self.tokens, *self.special.values()]) + 1
        spelled = [self.tokens.get(i, b"") for i in range(size)]
        for text, i in self.special.items():
            spelled[i] = text.encode()
        self._spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self._offsets = np.concatenate([[0], np.cumsum([len(b) for b in spelled])]).astype(np.int64)

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of ``token``, or -1."""
        found = self._shorter.get(token)
        if found is None:
            b = self.tokens[token]
            found = next((self._ids[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self._ids), -1)
            self._shorter[token] = found
        return found

    def beside(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay apart when their joined bytes are encoded by merges."""
        key = (left, right)
        found = self._beside.get(key)
        if found is None:
            found = self._beside[key] = self._apart(left, right)
        return found

    def _apart(self, left: int, right: int) -> bool:
        # merges happen by rank; undo the later of the two tokens' merges step by step, and see whether the
        # parts on both sides of the border would have merged before that
        limit = len(self._rank)
        while True:
            rank = self._rank.get((left, right))
            if rank is not None and rank < limit:
                return False
            a, b = self._made.get(left), self._made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                limit, left = a[0], a[2]  # of equal ranks, merges run from left to right
            else:
                limit, right = b[0] + 1, b[1]

    def encode(self, piece: bytes) -> list[int]:
        token = self._ids.get(piece)
        if token is not None and self._made_whole(token):
            return [token]
        longest = [None] * len(piece)
        for end, (i, n) in self._automaton.iter(piece.decode("latin-1")):
            longest[end - n + 1] = i  # ends ascend, so the last one is the longest
        out: list[int] = []
        left = bytearray(b"\x01") * (len(piece) + 1)  # positions that may still be reached
        at, token = 0, longest[0] if piece else None
        while token is not None:
            while True:
                end = at + self._length[token]
                if left[end] and (not out or self.beside(out[-1], token)):
                    out.append(token)
                    at = end
                    token = longest[at] if at < len(piece) else None
                    break
                nearer = self.shorter(token)
                if nearer >= 0:
                    token = nearer
                    continue
                left[at] = 0
                token = out.pop()
                at -= self._length[token]
        return out

    def _made_whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token (true for all tokens that merges can make)."""
        made = self._made.get(token)
        return made is None or self.beside(made[1], made[2]) is False

    def many(self, pieces: list[str]) -> list[bytes]:
        return [np.array(self.encode(p.encode()), "<u4").tobytes() for p in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        """The ids' bytes, gathered through the offset table."""
        start, size = self._offsets[ids], self._offsets[ids + 1] - self._offsets[ids]
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
        return self._spelled[where].tobytes()


class Encoder:
    """Texts to ids by the backtracking encoder."""

    def __init__(self, path: str):
        self.bpe = Backtracking(path)
        self._pieces = tokenizing.Pieces(path, words=False, encode=self.bpe.many)
        self._split = tokenizing.library(path).pre_tokenizer.pre_tokenize_str
        self._letters = byte_letters()

    def ids(self, text: str) -> bytes:
        if tokenizing.plain(text):
            return self._pieces.ids(text)
        out, rest = [], text
        while rest:
            # special strings first, the earliest one each time, as the library does
            found = [(rest.find(s), s) for s in self.bpe.special if s in rest]
            at, special = min(found) if found else (len(rest), "")
            for piece, _ in self._split(rest[:at]) if at else ():
                ids = self.bpe.encode(bytes(self._letters[c] for c in piece))
                out.append(np.array(ids, "<u4").tobytes())
            if special:
                out.append(np.array([self.bpe.special[special]], "<u4").tobytes())
            rest = rest[at + len(special):]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return tokenizing.text_of(self.bpe.decode(np.frombuffer(ids, "<u4").astype(np.int64)))


@functools.cache
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


@any_names
def encode(
    docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.json", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) plus ``ids`` (binary, little-endian unsigned 32-bit numbers).

    A null text is encoded as the empty text, with no ids. No rows move between tasks, so copies, hot keys and
    long texts need no care. Columns of ``docs`` with the new name are replaced.
    """
    return _mapped(docs, text, vocabulary, keep, lambda ids, back: (ids,), "ids binary")


@any_names
def round_trip(
    docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_50k.json", keep: list[str] | None = None
) -> DataFrame:
    """As ``encode``, but with ``n_tokens`` and the digests of the ids and of the text decoded from them."""

    def digests(ids, back):
        return (
            len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back(ids).encode()).hexdigest()
        )

    return _mapped(docs, text, vocabulary, keep, digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs, text, vocabulary, keep, make, schema):
    path = tokenizing.path_of(vocabulary)
    names = [part.split()[0] for part in schema.split(", ")]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]

    def run(batches):
        encoder = encoder_of(path)
        for batch in rows(batches, "_text"):
            made = []
            for value in batch.column("_text"):
                ids = encoder.ids(tokenizing.text_of(value.as_py()))
                made.append(make(ids, encoder.decode))
            columns = [batch.column(k) for k in range(len(kept))]
            kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            for k, part in enumerate(schema.split(", ")):
                columns.append(pa.array([m[k] for m in made], kinds[part.split()[1]]))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    chosen = docs.select(*[F.col(f"`{c}`") for c in kept], utf8(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name != "_text")
    return chosen.mapInArrow(run, f"{fields}, {schema}" if fields else schema)
