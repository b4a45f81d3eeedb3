"""Byte-level byte-pair encoding by a sentencepiece model that is written straight from a vocabulary of ranks.

Every token's bytes are spelled with one letter for each byte, its score is the negative rank, and the model normalises
nothing. Merging the best-scored neighbours first is then merging by rank, ties going to the left in both. Ids are
ranks. Texts are split into pre-tokens before; a pre-token that is a token itself is that token, as the ranks'
own library has it. Decoding maps each id's letters back to bytes.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm import tokenizing
from panelwise.llm.bpe import byte_letters
from panelwise.llm.common import any_names, rows, utf8

REMEMBERED, LONGEST = 400_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        found = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    if sorted(found.values()) != list(range(len(found))):
        raise ValueError(f"{path}: ranks are not 0 to {len(found) - 1}")
    missing = [b for b in range(256) if bytes([b]) not in found]
    if missing:
        raise ValueError(f"{path}: bytes without a token: {missing}")
    return found


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & (1 << 64) - 1)


def serialise(spelled: list[str]) -> bytes:
    """A sentencepiece model of byte-pair kind: piece ``i`` has score ``-i``; an unknown piece, never met, comes last."""
    # fixed values: field numbers and kinds of the public model format
    piece, trainer, normaliser = 1, 2, 3
    unknown_kind, merge_model = 2, 2
    out = [
        _message(piece, _message(1, s.encode()) + b"\x15" + struct.pack("<f", -float(rank)))
        for rank, s in enumerate(spelled)
    ]
    out.append(_message(piece, _message(1, b"<unk>") + _number(3, unknown_kind)))
    out.append(
        _message(
            trainer,
            _number(3, merge_model) + _number(4, len(spelled) + 1) + _number(40, len(spelled))
            + _number(41, -1) + _number(42, -1) + _number(43, -1),
        )
    )
    # no prefix blank, no removal of blanks, no other spelling of blanks
    out.append(_message(normaliser, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)))
    return b"".join(out)


@functools.cache
def _splitter() -> tuple[regex.Pattern, dict[int, str]]:
    """The splitting pattern, and stand-ins for the characters that this module's Unicode tables class otherwise.

    The ranks' library brings tables of its own. It is asked for the class of every character; one that it knows
    as a letter, number or neither, against the pattern's engine here, is split as its stand-in.
    """
    import public_tokenizers
    import tiktoken

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    theirs, ours = {}, {}
    for stand_in, kind in (("x", r"\p{L}"), ("0", r"\p{N}"), ("\t", r"\s")):
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
        theirs |= dict.fromkeys(bytes(probe.encode_ordinary(everything)).decode(), stand_in)
        ours |= dict.fromkeys(regex.findall(kind, everything), stand_in)
    odd = {ord(c): theirs.get(c, "!") for c in {*theirs, *ours} if theirs.get(c) != ours.get(c)}
    return regex.compile(public_tokenizers.PATTERN), odd


def pre_tokens(text: str) -> list[str]:
    split, stand_ins = _splitter()
    if tokenizing.plain(text) or stand_ins.keys().isdisjoint(map(ord, set(text))):
        return split.findall(text)
    return [text[slice(*m.span())] for m in split.finditer(text.translate(stand_ins))]


class Encoder:
    """Texts to ids and back under one file of ranks; short pre-tokens are remembered, up to ``REMEMBERED`` of them."""

    def __init__(self, path: str):
        import sentencepiece

        self._ranks = read_ranks(path)
        letter_of = {b: letter for letter, b in byte_letters().items()}
        self._spelling = {b: letter_of[b] for b in range(256)}
        spelled = [token.decode("latin-1").translate(self._spelling) for token in sorted(self._ranks, key=self._ranks.get)]
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise(spelled))
        back = byte_letters()
        tokens = [bytes(back[c] for c in self._model.id_to_piece(i)) for i in range(len(spelled))]
        self._bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self._known: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out = [self._ranks.get(b) for b in raw]
        open_ = [i for i, rank in enumerate(out) if rank is None]
        ids = self._model.encode([raw[i].decode("latin-1").translate(self._spelling) for i in open_], num_threads=1)
        out = [b"" if rank is None else struct.pack("<I", rank) for rank in out]
        for i, found in zip(open_, ids):
            out[i] = np.array(found, "<u4").tobytes()
        return out

    def ids(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit numbers."""
        pieces, known = pre_tokens(text), self._known
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

    def decode(self, ids: bytes) -> bytes:
        numbers = np.frombuffer(ids, "<u4").astype(np.int64)
        start, size = self._offsets[numbers], self._offsets[numbers + 1] - self._offsets[numbers]
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
        return self._bytes[where].tobytes()


@functools.cache
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


@any_names
def encode(
    docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) plus ``ids`` (binary, little-endian unsigned 32-bit numbers).

    A null text is the empty text and has no ids; an empty table gives an empty one. Bytes that are no UTF-8 count as
    replacement characters. Special strings are ordinary text. Rows stay in their tasks, so copies and long
    texts need no care. Columns of ``docs`` with the new name are replaced, all other names are free.
    """
    return _mapped(docs, text, vocabulary, keep, {"ids": pa.binary()}, lambda encoder, ids: (ids,))


def decode(tokens: DataFrame, ids: str = "ids", vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """``tokens`` plus ``data``, the bytes that ``ids`` (as ``encode`` writes them) stand for; null ids are none."""
    return _mapped(tokens, ids, vocabulary, None, {"data": pa.binary()}, lambda encoder, found: (encoder.decode(found),), True)


@any_names
def round_trip(
    docs: DataFrame, text: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken", keep: list[str] | None = None
) -> DataFrame:
    """As ``encode``, but with ``n_tokens`` and the digests of the ids and of the bytes decoded from them."""
    new = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    return _mapped(
        docs, text, vocabulary, keep, new,
        lambda encoder, ids: (
            len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()
        ),
    )


_SQL = {pa.binary(): "binary", pa.int64(): "long", pa.string(): "string"}


def _mapped(docs, column, vocabulary, keep, new: dict[str, pa.DataType], make, coded: bool = False):
    path = tokenizing.path_of(vocabulary)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]

    def run(batches):
        encoder = encoder_of(path)
        for batch in rows(batches, batch_column):
            values = (v.as_py() for v in batch.column(len(kept)))
            made = [make(encoder, v if coded else encoder.ids(tokenizing.text_of(v))) for v in values]
            columns = [batch.column(k) for k in range(len(kept))]
            columns += [pa.array([m[k] for m in made], kind) for k, kind in enumerate(new.values())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    batch_column = "_text"
    while batch_column in {c.lower() for c in kept}:
        batch_column += "_"
    chosen = docs.select(*[F.col(f"`{c}`") for c in kept], utf8(F.col(f"`{column}`")).alias(batch_column))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    return chosen.mapInArrow(run, ", ".join([*fields, *[f"{name} {_SQL[kind]}" for name, kind in new.items()]]))
