"""The corpus operators against brute force, on texts with nulls, copies, repeats, long and odd texts."""

from __future__ import annotations

import collections
import functools
import hashlib
import math
import pathlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwise.llm import bpe, context_tree, covertree, meeting, neardup, packing, quality, sharding, substrings, token_counts
from panelwise.llm import suffixes, tokenizing, warc
from panelwise.llm.common import once, release
from panelwise.llm.suffixes import common_prefixes, suffix_ranks
from panelwise.session import new_path

SCHEMA = "doc_id long, text string, lang string, source string, shard string, kept int, n_bytes string"


def some_texts() -> list[str | None]:
    pick = random.Random(7)
    words = ["".join(pick.choice("abdeilnorst") for _ in range(pick.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(pick.choice(words) for _ in range(n)) + ".\n"
    base, passage = prose(150), prose(90)
    out = [None, "", " \n\t", "one", "Two words", base, base, base.replace(words[0], words[1], 1)]
    out += [prose(20) + passage + prose(20) for _ in range(3)] + [prose(60) * 3, "a" * 1500, "ab" * 900, "é" * 700]
    out += ["x <|endoftext|> it's ÄÖ", "日本語 text \x85   end", prose(3000)]
    near = prose(200).split(" ")
    for k in range(12):
        copy = list(near)
        copy[k * 7] = words[k]
        out.append(" ".join(copy))
    return out + [prose(pick.randint(5, 80)) for _ in range(30)]


@pytest.fixture(scope="module")
def texts():
    return some_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", None][i % 2], ["hot", "hot", "b", None][i % 4], "s", 1, "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words_of(text):
    return (text or "").encode().split()


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


def test_token_counts_and_cache(spark, docs, texts, tmp_path):
    library = tokenizing.library(tokenizing.path_of("byte_bpe_50k.json"))
    cache = str(tmp_path / "cache")
    for _ in range(2):
        got = by_id(token_counts.count_tokens(docs, cache, keep=["doc_id", "n_bytes"]))
        for i, t in enumerate(texts):
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024)
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})


def test_byte_pairs(docs, texts):
    library = tokenizing.library(tokenizing.path_of("byte_bpe_50k.json"))
    got = by_id(bpe.round_trip(docs))
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_quality_counts_and_outliers(spark, docs, texts):
    got = by_id(quality.judge(docs))
    for i, t in enumerate(texts):
        w = words_of(t)
        windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        times = collections.Counter(windows)
        repeated = {p for k, x in enumerate(windows) if times[x] > 1 for p in range(k, k + 8)}
        lines = [line for line in (t or "").split("\n") if words_of(line)]
        assert got[i]["n_words"] == len(w) and got[i]["n_repeat_words"] == len(repeated)
        assert got[i]["n_dup_lines"] == len(lines) - len(set(lines))
        assert got[i]["word_chars"] == sum(len(x.decode()) for x in w)
        assert got[i]["base_failed"] == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
    pick = random.Random(1)
    clean = [" ".join("abc"[: pick.randint(1, 3)] * 2 for _ in range(60)) + f" {k}" for k in range(80)]
    noisy = [" ".join(f"w{j}$$$" for j in range(60)) for _ in range(3)]
    frame = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(clean + noisy)], "doc_id long, text string, lang string, source string")
    kept = {i: r["kept"] for i, r in by_id(quality.judge(frame)).items() if not r["base_failed"]}
    assert all(v == (i < 80) for i, v in kept.items()) and sum(i >= 80 for i in kept) == 3


def test_small_groups_are_judged(spark):
    pick = random.Random(2)
    clean = [" ".join("abc"[: pick.randint(1, 3)] * 2 for _ in range(60)) + f" {k}" for k in range(40)]
    texts = clean + [" ".join(f"w{j}$$$" for j in range(60))] * 3
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 8}" if k < 42 else "alone") for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = by_id(quality.judge(frame))
    assert all(r["distance"] is not None and r["kept"] == (i < 40) for i, r in got.items() if not r["base_failed"])
    assert sum(i >= 40 and not r["base_failed"] for i, r in got.items()) == 3


def test_moderate_outliers_are_rejected(spark):
    pick = random.Random(4)
    word = lambda: "".join(pick.choices("abcdefghij", k=pick.randint(3, 6)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(60)]
    barred = [" ".join(word() + " |" * (j % 3 == 0) for j in range(60)) for _ in range(2)]
    again = [" ".join([word() for _ in range(700)] + ["abcde"] * 295) for _ in range(2)]
    frame = spark.createDataFrame(
        [(k, t, "en", "s") for k, t in enumerate(clean + barred + again)], "doc_id long, text string, lang string, source string"
    )
    got = by_id(quality.judge(frame))
    assert not any(r["base_failed"] for r in got.values())
    assert all(r["kept"] == (i < 60) for i, r in got.items())


def test_suffix_order(spark):
    pick = random.Random(3)
    strings = [[pick.choice([5, 6, 7]) for _ in range(pick.randint(1, 20))] for _ in range(15)] + [[5, 6] * 9, [5]]
    frame = spark.createDataFrame(list(enumerate(strings)), "sid long, letters array<long>")
    got = {r["sid"]: r["ranks"] for r in suffix_ranks(frame, 30).collect()}
    every = sorted(s[p:] for s in strings for p in range(len(s)))
    assert all(got[i] == [1 + every.index(s[p:]) for p in range(len(s))] for i, s in enumerate(strings))
    prefixes = [(got[i][p], np.array(s[p:], np.int64).tobytes()) for i, s in enumerate(strings) for p in range(len(s))]
    shared = {r["rank"]: r["shared"] for r in common_prefixes(spark.createDataFrame(prefixes, "rank long, prefix binary")).collect()}
    assert shared[got[16][0]] >= 1 and max(shared.values()) < 20


def test_suffix_order_keeps_no_cut_but_its_ranks(spark):
    folder = pathlib.Path(new_path(spark, "any")).parent
    folder.mkdir(parents=True, exist_ok=True)
    before = {p.name for p in folder.iterdir()}
    strings = [[5, 6, 7] * 7, [6, 7] * 5, [9]]
    ranks = suffix_ranks(spark.createDataFrame(list(enumerate(strings)), "sid long, letters array<long>"), 21)
    got = {r["sid"]: r["ranks"] for r in ranks.collect()}
    every = sorted(s[p:] for s in strings for p in range(len(s)))
    assert all(got[i] == [1 + every.index(s[p:]) for p in range(len(s))] for i, s in enumerate(strings))
    assert [p.name for p in folder.iterdir() if p.name not in before] == [pathlib.Path(ranks._cut_path).name]
    # two letters that agree in their low bits: a place may repeat further by them, never less far
    prefixes = [(1, [1, 2, 3]), (2, [1, 2 + (1 << 16), 3]), (3, [7, 7])]
    shared = {}
    for kind in (np.int64, np.uint16):
        rows = [(rank, np.array(p).astype(kind).tobytes()) for rank, p in prefixes]
        found = common_prefixes(spark.createDataFrame(rows, "rank long, prefix binary"), kind).collect()
        shared[kind] = [n for _, n in sorted((r["rank"], r["shared"]) for r in found)]
    assert shared == {np.int64: [1, 1, 0], np.uint16: [3, 3, 0]}


def test_repeated_strings(docs, texts):
    got = by_id(substrings.remove_repeats(docs, length=400))
    times = collections.Counter()
    for t in texts:
        b = (t or "").encode()
        times.update(b[p:p + 400] for p in range(len(b) - 399))
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if times[b[p:p + 400]] > 1:
                gone[p:p + 400] = True
        assert got[i]["kept_bytes"] == np.frombuffer(b, np.uint8)[~gone].tobytes()
        assert (got[i]["n_bytes"], got[i]["n_removed"]) == (len(b), int(gone.sum()))
        assert got[i]["n_spans"] == len(got[i]["spans"]) // 2


def test_copies_and_loops_are_few_letters(spark, monkeypatch):
    pick = random.Random(8)
    words = ["".join(pick.choices("abcdefghij", k=5)) for _ in range(400)]
    plain = " ".join(pick.choices(words, k=900))
    loop = "La " * 900
    texts = [plain, plain, plain[:2000] + "-" + plain[2001:], loop, "x " + loop[:1500] + "y " + loop[:900] + plain[300:900], loop[:1200] + "y " + loop]
    texts += [" ".join(pick.choices(words, k=60)) + t[600:1100] + " ".join(pick.choices(words, k=60)) for t in texts]
    texts += ["ab" * 40 + t[700:900] for t in (plain, texts[7])] + [plain[:160], loop[:160], "", "short"]
    letters = []

    def counted(strings, depth):
        letters.append(strings.select(F.sum(F.size("letters"))).first()[0])
        return suffix_ranks(strings, depth)

    monkeypatch.setattr(substrings, "suffix_ranks", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in substrings.remove_repeats(frame, length=160).collect()}
    times = collections.Counter(t[p:p + 160] for t in texts for p in range(len(t) - 159))
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 159):
            if times[t[p:p + 160]] > 1:
                gone[p:p + 160] = True
        assert got[i]["kept_bytes"] == np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()
        assert got[i]["n_spans"] == int((np.diff(np.concatenate([[0], gone, [0]]).astype(int)) == 1).sum())
    assert sum(map(len, texts)) > 30000 and letters[0] < 400


def test_keys_meet_in_ranges(spark, monkeypatch):
    pick = np.random.default_rng(5)
    blocks = [pick.integers(0, 1 << 64, 300, np.uint64) for _ in range(7)]
    blocks = [np.concatenate([b, np.repeat(blocks[0][:3], 50), blocks[k - 1][:20]]) for k, b in enumerate(blocks)] + [np.zeros(0, np.uint64)]
    frame = spark.createDataFrame([(k, bytearray(b.tobytes())) for k, b in enumerate(blocks)], "block long, run binary")
    keys = lambda batch, row: meeting.counted(meeting.numbers(batch, "run", row, np.uint64)[None])
    monkeypatch.setattr(meeting, "RANGE_BYTES", 512)
    made = meeting.meet(frame, "seen", F.octet_length("run"), lambda *at: keys(*at)[0], lambda lines: meeting.several(lines)[0])
    times = collections.Counter(x >> 1 for b in blocks for x in b.tolist())
    got = {r["block"]: np.frombuffer(b"".join(r["seen"]), np.uint8) for r in made.collect()}
    assert set(got) == set(range(7))
    for k, b in enumerate(blocks[:7]):
        one, inverse, _ = meeting.counted(b[None])
        assert one.shape[1] == len(set(x >> 1 for x in b.tolist())) == len(got[k])
        assert got[k][inverse].tolist() == [times[x >> 1] > 1 for x in b.tolist()]


def test_cuts_are_written_by_zstd(spark):
    folder = pathlib.Path(once(spark.range(9))._cut_path)
    files = [p.name for p in folder.iterdir() if p.suffix == ".parquet"]
    assert files and all(".zstd." in name for name in files)


def test_windows_are_compared_when_their_surroundings_are_deleted(docs, monkeypatch):
    held, beside = {}, []

    def kept(df, *args, **named):
        if "w1" in df.columns:
            beside.append(sorted(held.values()))
        made = once(df, *args, **named)
        held[made._cut_path] = made.columns
        return made

    def gone(*cuts):
        release(*cuts)
        for df in cuts:
            held.pop(df._cut_path, None)

    monkeypatch.setattr(substrings, "once", kept)
    monkeypatch.setattr(substrings, "release", gone)
    substrings.remove_repeats(docs, length=400, keep=["doc_id"], with_text=False)
    assert len(beside) == 2 and all("core" not in columns and "n" not in columns for cuts in beside for columns in cuts)
    assert sorted(held.values()) == [["doc_id", "_data", "_row"], ["row", "spans"]]


def test_rows_of_blocks_stay_small(spark, monkeypatch):
    pick = random.Random(11)
    words = ["".join(pick.choices("abcdefghij", k=5)) for _ in range(3000)]
    passages = [" ".join(pick.choices(words, k=60)) for _ in range(40)]
    # passages whose surroundings differ, so that all windows at their borders are compared
    texts = [" ".join(x for _ in range(30) for x in (pick.choice(passages), *pick.choices(words, k=8))) for _ in range(40)]
    largest = collections.Counter()

    def told(df, *args, **named):
        made = once(df, *args, **named)
        for name in {"part", "place"} & set(df.columns):
            largest[name] = max(largest[name], made.select(F.max(F.octet_length(name))).first()[0])
        return made

    monkeypatch.setattr(substrings, "once", told)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    whole = by_id(substrings.remove_repeats(frame, length=160))
    assert largest["place"] > 8 * (2 << 12) and 0 < whole[0]["n_removed"] < whole[0]["n_bytes"]
    for name, limit in (("RUN_BYTES", 1 << 15), ("PIECE_BYTES", 1 << 12), ("WINDOWS", 1 << 10), ("LETTERS", 1 << 8)):
        monkeypatch.setattr(substrings, name, limit)
    monkeypatch.setattr(suffixes, "LETTERS", 1 << 8)
    monkeypatch.setattr(meeting, "RANGE_BYTES", 1 << 14)
    largest.clear()
    assert by_id(substrings.remove_repeats(frame, length=160)) == whole
    # a piece, or a text, more than the limit
    assert largest["part"] < (1 << 15) + 2 * len(texts[0]) and largest["place"] <= 8 * ((1 << 10) + 2 * len(texts[0]))
    times = collections.Counter(t[p:p + 160] for t in texts for p in range(len(t) - 159))
    for i, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 159):
            if times[t[p:p + 160]] > 1:
                gone[p:p + 160] = True
        assert whole[i]["n_removed"] == gone.sum()


def test_ranges_and_runs_are_small_by_default():
    # a task's arrays are about ten times as large, and two tasks share an executor
    assert meeting.RANGE_BYTES <= 4 << 20 and substrings.RUN_BYTES <= 1 << 19 and 24 * substrings.WINDOWS <= 1 << 20


def test_near_duplicates(docs, texts):
    got = by_id(neardup.find_groups(docs, percent=80))
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for t in texts:
        w = (t or "").encode().translate(low).split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                parent = [new if p == old else p for p in parent]
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), parent[i], parent[i] == i)


def test_copies_that_meet_only_in_their_original(spark):
    # each copy changes two words in a place of its own: similar to the original, not to each other
    words = [f"w{k}" for k in range(150)]
    rows = [(100, " ".join(words))]
    for k in range(12):
        copy = list(words)
        copy[12 * k + 1], copy[12 * k + 7] = f"x{k}", f"y{k}"
        rows.append((k, " ".join(copy)))
    rows.append((7000, " ".join(f"z{k}" for k in range(150))))
    got = by_id(neardup.find_groups(spark.createDataFrame(rows, "doc_id long, text string"), percent=85))
    assert {i: r["component_id"] for i, r in got.items()} == {i: 7000 if i == 7000 else 0 for i, _ in rows}


def test_packing(docs, texts):
    library = tokenizing.library(tokenizing.path_of("word_bpe_49k.json"))
    for targets in (None, {"hot": 3.0, "b": 1.0}):
        rows = packing.pack(docs, length=256, window_sequences=2, targets=targets, keep=["doc_id"]).collect()
        used = collections.defaultdict(list)
        for i, t in enumerate(texts):
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            at = 0
            for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"]):
                piece = ids[at:at + r["length"]].tobytes()
                assert (r["start"], r["ids"], r["ids_crc32"]) == (at, bytearray(piece), zlib.crc32(piece))
                used[r["sequence_id"]].append((r["offset"], r["length"]))
                at += r["length"]
            assert at == len(ids) == r["doc_tokens"]
        for pieces in used.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at == 256 or at & (at - 1) == 0


def test_packing_holds_many_sources_to_their_targets(spark):
    pick = random.Random(7)
    rows = [(k, " ".join(pick.choices(["one", "two", "red", "blue"], k=40)), f"host{k % 80:02}") for k in range(800)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for targets in (None, {"host79": 20.0}):
        got = packing.pack(frame, length=64, window_sequences=16, targets=targets, keep=["doc_id", "source"], with_ids=False).collect()
        sizes, used = collections.Counter(), collections.Counter()
        for r in got:
            sizes[r["source"]] += r["length"]
        assert len(sizes) == 80
        weight = {s: float(sizes[s] if targets is None else targets.get(s, 1.0)) for s in sizes}
        # by bisection: the time at which all queues together have given a window
        low, high = 0.0, float(max(sizes.values()))
        for _ in range(200):
            v = (low + high) / 2
            low, high = (low, v) if sum(min(sizes[s], weight[s] * v) for s in sizes) > 1024 else (v, high)
        wanted = {s: int(min(sizes[s], weight[s] * v)) for s in sizes}
        for r in got:
            used[r["source"]] += min(r["length"], max(0, sum(wanted.values()) - 64 * r["sequence_id"] - r["offset"]))
        assert sum(abs(used[s] - wanted[s]) for s in sizes) <= 4
    with pytest.raises(ValueError, match="without a queue"):
        packing.pack(frame, queues=5, targets={f"host{k:02}": 2.0 for k in range(80)})


def plain_context_tree(learned: list[bytes], depth: int):
    """Log10 probability of a text, from counts in dictionaries and the definition of the weights."""
    end = b"\0"
    steps = lambda text: [
        ((end * depth + text + end)[k:k + depth], (text + end)[k]) for k in range(len(text) + 1)
    ]
    bits = lambda byte: [((1 << k) | byte >> (8 - k), byte >> (7 - k) & 1) for k in range(8)]
    counts = collections.defaultdict(lambda: [0, 0])
    longer = collections.defaultdict(set)
    for text in learned:
        for context, byte in steps(text):
            for node, bit in bits(byte):
                for d in range(depth + 1):
                    tail = context[depth - d:]
                    counts[tail, node][bit] += 1
                    if d < depth:
                        longer[tail, node].add(context[depth - d - 1:])

    def kt(pair):
        return math.lgamma(pair[0] + 0.5) + math.lgamma(pair[1] + 0.5) - math.lgamma(sum(pair) + 1) - math.log(math.pi)

    @functools.cache
    def weighted(tail, node):
        own = kt(counts[tail, node])
        if len(tail) == depth:
            return own
        return np.logaddexp(own, sum(weighted(x, node) for x in longer[tail, node])) + math.log(0.5)

    def one(context, node, d=0):
        tail = context[depth - d:]
        zeros, ones = counts[tail, node]
        estimate = (ones + 0.5) / (zeros + ones + 1)
        if d == depth or not sum(counts[context[depth - d - 1:], node]):
            return estimate
        share = math.exp(kt((zeros, ones)) + math.log(0.5) - weighted(tail, node))
        return share * estimate + (1 - share) * one(context, node, d + 1)

    return lambda text: sum(
        math.log10(p if bit else 1 - p)
        for context, byte in steps(text) for node, bit in bits(byte) for p in [one(context, node)]
    )


@pytest.mark.parametrize("depth", [1, 4])
def test_context_tree(spark, monkeypatch, depth):
    monkeypatch.setattr(context_tree, "BLOCK_BYTES", 300)
    texts = ["", None, "A", "the cat sat on the mat", "The cat sat.", "ab" * 60, "the mat sat", "日本語 é", "new words, zq", "a cat"]
    rows = [(k, t, k in (6, 8)) for k, t in enumerate(texts)] + [(k + 10, "the cat sat on the mat", False) for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, out boolean")
    plain = plain_context_tree([(t or "").lower().encode() for _, t, out in rows if not out], depth)
    got = {r["doc_id"]: r for r in context_tree.score(docs, held_out=F.col("out"), keep=["doc_id"], depth=depth).collect()}
    assert len(got) == len(rows)
    for k, text, out in rows:
        assert got[k]["score"] == pytest.approx(plain((text or "").lower().encode()), abs=1e-4)
        assert got[k]["held_out"] == out and (out or got[k]["n_known"] == got[k]["n_tokens"])


def test_context_tree_answers_a_block_once_a_task(monkeypatch):
    asked = pa.RecordBatch.from_arrays(
        [
            pa.array([4, 4, 9]), pa.array([0, 2, 0], pa.int32()), pa.array([b"ab", b"z", b"a"]),
            pa.array([[97, 98], [122], [97]], pa.list_(pa.int32())), pa.array([[-1.0, -2.0], [-3.0], [-4.0]], pa.list_(pa.float32())),
        ],
        names=["block", "place", "asked", "bytes", "logs"],
    )
    got = [row for batch in context_tree._answers(iter([asked, asked.slice(1, 1)])) for row in batch.to_pylist()]
    assert got == [
        {"block": 4, "place": [0, 1, 2, 2], "logs": [-1.0, -2.0, -3.0, -3.0]}, {"block": 9, "place": [0], "logs": [-4.0]},
    ]
    monkeypatch.setattr(context_tree, "SLICE_BYTES", 8)
    texts = pa.RecordBatch.from_arrays([pa.array([b"one Two", b"", b"a text longer than a slice", b"two"])], names=["_text"])
    assert [part.num_rows for part in context_tree._slices(texts)] == [2, 1, 1]
    hashes, owner = context_tree._word_hashes(texts)
    assert owner.tolist() == [0, 0, 2, 2, 2, 2, 2, 2, 3] and hashes[1] == hashes[-1]


def test_context_tree_keeps_one_cut_and_one_worker_a_task(spark, monkeypatch):
    plans, made = [], []

    def kept(df, *args, **named):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        made.append(once(df, *args, **named))
        return made[-1]

    monkeypatch.setattr(context_tree, "once", kept)
    docs = spark.createDataFrame([(1, "a b a b"), (2, "b a"), (3, None)], "doc_id long, text string")
    scored = context_tree.score(docs, keep=["doc_id", "text"], depth=2)
    assert scored.count() == 3
    # no step in Python feeds another one without a shuffle or a cut between
    assert len(plans) > 5 and not any(re.search(r"MapInArrow.*\n[ :+-]*(Project.*\n[ :+-]*)*MapInArrow", p) for p in plans)
    assert [pathlib.Path(df._cut_path).exists() for df in made] == [False] * (len(made) - 1) + [True]


def test_context_tree_without_training(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in context_tree.score(docs, held_out=F.lit(True)).collect()}
    assert got[1]["score"] == pytest.approx(-4 * 8 * math.log10(2), abs=1e-4) and got[2]["train_tokens"] == 0


def test_archives_and_lookup(spark, tmp_path):
    big = "<p>" + "text " * 400
    rows = [(1, "http://a.b.com/x", big), (2, "http://a.b.com/x", big), (3, None, None), (None, "http://c.org", big), (4, "bad url]", "ö")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives, index = str(tmp_path / "a"), str(tmp_path / "i")
    warc.write_archives(pages, archives)
    warc.build_index(spark, archives, index, block_lines=2)
    got = {r["page_id"]: r for r in warc.read_records(spark, archives, warc.captures(spark, index)).collect()}
    assert len(got) == 5 and got[1]["refers_to"] == 2 and got[1]["record_type"] == "revisit"
    assert bytes(got[2]["payload"]) == big.encode() and got[3]["payload_bytes"] == 0 and got[None]["record_type"] == "response"
    assert {r["page_id"] for r in warc.lookup(spark, index, ["http://a.b.com/x"]).collect()} == {1, 2}
    assert len(list(warc.members(warc._member(bytes(17 << 20))))) == 1


def test_lookup_of_encoded_urls(spark, tmp_path):
    urls = ["http://a.b/é", "http://a.b/x y", " http://a.b/z ", "http://ö.org/?q=ü", "http://a.b/%C3%A9", "http://a.b/plain", "http://A.b/\tt", "a b]["]
    pages = spark.createDataFrame([(k, u, f"<p>{k}") for k, u in enumerate(urls * 2)], "page_id long, url string, html string")
    archives, index = str(tmp_path / "a"), str(tmp_path / "i")
    warc.write_archives(pages, archives)
    warc.build_index(spark, archives, index, block_lines=3)
    every = warc.captures(spark, index).collect()
    for url in urls:
        got = {r["page_id"] for r in warc.lookup(spark, index, [url]).collect()}
        assert got == {r["page_id"] for r in every if r["url"] == warc.encoded(url)} and len(got) >= 2


def test_top_k_ties_and_unusable_vectors(spark):
    pick = random.Random(5)
    rows = [(i, [pick.choice([-0.5, 0.25, 1.0]) for _ in range(4)]) for i in range(200)]
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (None, [1.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = covertree.top_k(frame, frame.filter("vec_id % 50 = 0"), block_rows=60, pivots=3).collect()
    vectors = {i: [int(256 * x // 1) for x in v] for i, v in rows[:200]}
    for q in (0, 50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == best


def test_shards(docs, texts):
    got = sharding.assign_shards(docs, keep=["doc_id", "shard"]).collect()
    assert sharding.longest_first({"a": 5, "b": 4, "c": 3}, 2) == {"a": 0, "b": 1, "c": 1}
    shard = {r["doc_id"]: r["shard"] for r in got}
    assert shard[5] == shard[6] and len(got) == len(texts)
    for s in set(shard.values()):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    for found in (
        token_counts.count_tokens(none, str(tmp_path / "c")), bpe.encode(none), quality.judge(none),
        substrings.remove_repeats(none), neardup.find_groups(none), packing.pack(none), context_tree.score(none),
        sharding.assign_shards(none),
    ):
        assert found.count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert covertree.top_k(vectors, vectors).count() == 0


def test_sets_that_share_an_id(spark):
    """Sets of equal size under one id keep all their links, and an id joins them."""
    pick = random.Random(11)
    long = lambda: [f"w{pick.randrange(10**6)}" for _ in range(60)]
    texts = [long() for _ in range(5)]
    rows = [(5, t) for t in texts[:4]] + [(k + 1, [*t[:-1], "end"]) for k, t in enumerate(texts)]
    rows += [(9, long()), (None, texts[0]), (8, [])]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.find_groups(frame, percent=80).collect()]
    want = [(5, 1, False)] * 5 + [(1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (9, 9, True), (8, 8, True), (None, None, True)]
    assert sorted(map(str, got)) == sorted(map(str, want))
