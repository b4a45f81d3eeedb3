"""Byte pieces against the ranks' own library, on odd, long, empty and missing texts."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import tiktoken

from panelwise.llm import byte_pieces, queries, tokenizing

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    ranks = byte_pieces.read_ranks(tokenizing.path_of(VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(5)
    draws = [lambda: pick.randrange(32, 127), lambda: pick.randrange(0x300), lambda: pick.randrange(0xE000, 0x110000), lambda: 32]
    odd = ["".join(chr(pick.choice(draws)()) for _ in range(pick.randint(1, 300))) for _ in range(200)]
    plain = ["it's  we'LL\n\n 12345 don't", "naïve Straße — €5", "日本語 text", "x <|endoftext|> y", "\x00\x85  ."]
    return [None, "", " ", *plain, *plain, "a" * 50_000, "ab " * 20_000, "é" * 3_000, " " * 5_000, *odd]


def test_round_trip(spark, reference, texts):
    rows = [(i, t, "own", i, "t") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string, N_Tokens int, `a b` string").repartition(3)
    got = {r["doc_id"]: r for r in byte_pieces.round_trip(docs).collect()}
    assert set(got) == set(range(len(texts)))
    for i, text in enumerate(texts):
        ids = reference.encode_ordinary(text or "")
        assert (got[i]["n_tokens"], got[i]["_text"], got[i]["a b"]) == (len(ids), "own", "t")
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_decode_gives_the_bytes_back(spark, texts):
    docs = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id long, text string, data binary")
    for r in byte_pieces.decode(byte_pieces.encode(docs)).collect():
        assert bytes(r["data"]) == (texts[r["doc_id"]] or "").encode()
    missing = spark.createDataFrame([(None,)], "ids binary")
    assert [bytes(r["data"]) for r in byte_pieces.decode(missing).collect()] == [b""]


def test_every_token_comes_from_its_merges():
    encoder = byte_pieces.encoder_of(tokenizing.path_of(VOCABULARY))
    tokens = sorted(encoder._ranks, key=encoder._ranks.get)
    ids = encoder._model.encode([t.decode("latin-1").translate(encoder._spelling) for t in tokens], num_threads=1)
    assert ids == [[i] for i in range(len(tokens))]


def test_empty_table_and_bad_vocabulary(spark, tmp_path):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert byte_pieces.round_trip(nothing).collect() == []
    bad = tmp_path / "ranks"
    bad.write_text("YQ== 0\n")
    with pytest.raises(ValueError, match="bytes without a token"):
        byte_pieces.read_ranks(str(bad))


def test_query_covers_the_whole_table(spark, reference, texts, tmp_path):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op12_byte_pieces(spark, str(tmp_path)).collect()}
    assert got == {i: len(reference.encode_ordinary(t or "")) for i, t in enumerate(texts)}
