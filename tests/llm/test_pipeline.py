"""The whole corpus pipeline against plain sets, counted substrings and the tokenizers library."""

from __future__ import annotations

import collections
import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from panelwise.llm import quality, tokenizing


def documents() -> list[tuple[int, str | None]]:
    pick = random.Random(5)
    words = ["".join(pick.choice("abdeilnorst") for _ in range(pick.randint(2, 9))) for _ in range(900)]
    prose = lambda n: " ".join(pick.choice(words) for _ in range(n))
    passage = prose(100)
    texts = [prose(pick.randint(120, 200)) for _ in range(12)]
    texts += [texts[0], texts[0], texts[1].rsplit(" ", 1)[0] + " zzz", "too short", None, ""]
    texts += [f"{prose(60)} {passage} {prose(60)}" for _ in range(3)] + [f"{prose(400)} é {prose(1500)}"]
    return list(enumerate(texts))


def near_copies_gone(texts: dict[int, str]) -> dict[int, str]:
    """One text of each group of texts whose sets of five words overlap by 0.8."""
    sets = {}
    for i, text in texts.items():
        words = text.lower().split()
        sets[i] = {tuple(words[k:k + 5]) for k in range(len(words) - 4)}
    leader = {i: i for i in texts}
    for _ in texts:
        for i in texts:
            for j in texts:
                if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    leader[i] = leader[j] = min(leader[i], leader[j])
    return {i: t for i, t in texts.items() if leader[i] == i}


def repeats_gone(texts: dict[int, str]) -> dict[int, str]:
    data = {i: t.encode() for i, t in texts.items()}
    times = collections.Counter(b[p:p + 400] for b in data.values() for p in range(len(b) - 399))
    out = {}
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if times[b[p:p + 400]] > 1:
                gone[p:p + 400] = True
        out[i] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode()
    return {i: t for i, t in out.items() if t}


def test_run_against_plain_stages(spark, tmp_path):
    rows = [(i, t, "en", "web", len(t or "")) for i, t in documents()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    passed = {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}
    assert not passed & {15, 16, 17} and len(passed) > 15
    left = near_copies_gone({i: t for i, t in documents() if i in passed})
    assert len(left) < len(passed)
    cleaned = repeats_gone(left)
    assert any(cleaned[i] != left[i] for i in cleaned)
    library = Tokenizer.from_file(tokenizing.path_of("word_bpe_49k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(cleaned)
    for i, text in cleaned.items():
        ids = [x for _, part in sorted(pieces[i]) for x in part]
        assert ids == [*library.encode(text, add_special_tokens=False).ids, 2]
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
