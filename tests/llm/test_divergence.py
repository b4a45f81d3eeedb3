"""The divergence audit against brute force, on odd, empty, repeated and missing values."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from panelwise.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, value string"


def brute_force(rows, least_docs=10, top=10):
    counts, docs, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = TERM.findall(low)
        counts.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang, sources in groups.items():
        kept = [w for (g, w), n in docs.items() if g == lang and n >= least_docs]
        total = {s: sum(counts[lang, s, w] for w in kept) for s in sources}
        chance = lambda n, whole: 1 + 10**9 * (n + 2) // (whole + 2 * len(kept))
        p = {(s, w): chance(counts[lang, s, w], total[s]) for s in sources for w in kept}
        q = {w: chance(sum(counts[lang, s, w] for s in sources), sum(total.values())) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s, w], p[o, w]) for w in kept), o.encode()) for o in sources - {s}]
            own = [(-f(p[s, w], q[w]), w.encode()) for w in kept if counts[lang, s, w] and p[s, w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(found, 1)]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def odd_rows():
    pick = random.Random(21)
    words = ["Über", "x", "Mañana", "日本", "abc", "DEF", "it's", "a1b", "z" * 3000, "é\x85è"] + [f"w{chr(97 + k)}" for k in range(26)]
    text = lambda: pick.choice([" ", "\n", "—", "1"]).join(pick.choices(words, range(len(words), 0, -1), k=pick.randint(0, 60)))
    rows = [(i, text(), pick.choice(["en", "de", None]), pick.choice(["hot", "hot", "b", "é", "Z", None])) for i in range(260)]
    rows += [(1000 + i, "same Same text", "en", "hot") for i in range(60)]
    rows += [(2000, "rare words only", "xx", "one"), (2001, None, "xx", "two"), (2002, "", "yy", "alone"), (1, "again", "en", "b")]
    rows += [(3000 + i, "shared", "zz", "only") for i in range(10)]
    return [(*r, "t", 1, "v") for r in rows]


def test_odd_rows(spark, odd_rows):
    got = divergence.audit(spark.createDataFrame(odd_rows, SCHEMA).repartition(4))
    assert rows_of(got) == brute_force(odd_rows)


def test_small_blocks_and_sets(spark, odd_rows):
    """Terms over many blocks, sources over many sets, counts passed on after every few terms."""
    before = divergence.BLOCK_TERMS, divergence.SET_SOURCES, divergence.HELD_TERMS
    divergence.BLOCK_TERMS, divergence.SET_SOURCES, divergence.HELD_TERMS = 4, 2, 5
    try:
        got = rows_of(divergence.audit(spark.createDataFrame(odd_rows, SCHEMA), least_docs=3, top=2))
    finally:
        divergence.BLOCK_TERMS, divergence.SET_SOURCES, divergence.HELD_TERMS = before
    assert got == brute_force(odd_rows, 3, 2)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert divergence.audit(empty).collect() == []
    blank = [(1, None, None, None, "t", 1, "v"), (2, "", None, "b", "t", 1, "v")]
    got = rows_of(divergence.audit(spark.createDataFrame(blank, SCHEMA)))
    assert got == [("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)]


def test_probabilities_of_huge_counts_are_exact(spark):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(n, 4 * 10**17, 10**9) for n in (0, 8_999_999_999, 9_000_000_000, 10**17)], "n long, total long, terms long")
    got = frame.select("n", divergence.probability(F.col("n"), F.col("total"), F.col("terms"))).collect()
    assert {r[0]: r[1] for r in got} == {n: 1 + 10**9 * (n + 2) // (4 * 10**17 + 2 * 10**9) for n, _ in got}


def test_bitmap_cells_equal_direct_sums():
    pick = np.random.default_rng(9)
    names, terms = ["b", "a", "c"], 130
    absent, counts = np.array([7, 3, 11]), pick.integers(0, 4, (3, terms))
    p = np.where(counts > 0, counts * 1000 + absent[:, None], absent[:, None])
    rows = [(names[s], -1, terms, int(absent[s]), 0) for s in range(3)]
    for s in range(3):
        for level in (1, 2, 3):
            for word in range(3):
                inside = [t for t in range(64 * word, min(terms, 64 * word + 64)) if counts[s, t] == level]
                bits = sum(1 << (t % 64) for t in inside)
                if bits:
                    signed = bits - (1 << 64) if bits >= 1 << 63 else bits
                    rows.append((names[s], word, signed, int(level * 1000 + absent[s]), 0))
    table = pa.table(dict(zip(("source", "word", "bits", "p", "part"), map(list, zip(*rows)))))
    met = divergence._meet([pa.scalar(x) for x in ("en", 0, 0, 0)], table).to_pylist()
    for r in met:
        a, b = p[names.index(r["a"])], p[names.index(r["b"])]
        assert r["value"] == int(((a - b) ** 2 // (a + b)).sum())
    assert sorted((r["a"], r["b"]) for r in met) == [("a", "b"), ("a", "c"), ("b", "c")]
