"""Divergence between the sources of a language, from bitmaps of terms by count.

A source's smoothed probability of a term depends on the term's count there alone. So each source keeps, for each count
that occurs, the set of terms with that count as a bitmap. For two sources AND and popcount of their bitmaps
give the number of terms with every pair of counts, and each such cell is multiplied by one divergence. Count zero has no bitmap: its
cells are what the others leave of a bitmap, or of the whole vocabulary.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm.common import once, release, rows, utf8

SCALE = 1_000_000_000
#: A task holds so many distinct terms, over all its groups, before it passes their counts on.
HELD_TERMS = 600_000
#: Terms of a block and sources of a set: a pair of sets meets over one block in one call, so they bound its memory.
BLOCK_TERMS, SET_SOURCES = 1024, 64
#: ASCII letters in lower case and all bytes of longer characters stay, everything else parts terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents; a row with an empty term for every group."""

    def tally(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        for batch in rows(batches, "text"):
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, (key, value) in enumerate(zip(zip(langs, sources), batch.column(2))):
                if key not in held:
                    held[key] = (Counter({b"": 0}), Counter())
                words = value.as_py().translate(_TERM_BYTES).split()
                occurrences, documents = held[key]
                occurrences.update(words)
                documents.update(set(words))
            if sum(len(o) for o, _ in held.values()) > HELD_TERMS:
                yield from _emitted(held)
                held = {}
        yield from _emitted(held)

    read = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"),
        utf8(F.col(f"`{text}`")).alias("text"),
    )
    found = read.mapInArrow(tally, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def _emitted(held: dict):
    for (lang, source), (occurrences, documents) in held.items():
        terms = list(occurrences)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()), pa.array(list(occurrences.values()), pa.int64()),
                pa.array([documents[t] for t in terms], pa.int64()),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )


def probability(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + 2) / (total + 2 * terms))``, exact; null without terms."""
    all_ = F.nullif(total + 2 * terms, F.lit(0).cast("long"))
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    # the same number either way; decimals only where the product leaves a long
    short = F.call_function("div", F.lit(SCALE).cast("long") * (n.cast("long") + 2), all_)
    return F.when(n < 9_000_000_000, short).otherwise(F.call_function("div", wide, all_.cast("decimal(20,0)"))) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // np.maximum(p + q, 1)


def level_bitmaps(cells: DataFrame) -> DataFrame:
    """``(lang, block, part, source, p, word, bits)``: for each group and count its terms of a block, 64 to a word.

    Only words with a term are stored. Counts stand for themselves through ``p``, which follows from them.
    """
    bit = F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")
    stored = cells.groupBy("lang", "block", "part", "source", "n", F.expr("CAST(bit DIV 64 AS INT)").alias("word")).agg(
        F.first("p").alias("p"), F.bit_or(bit).alias("bits")
    )
    return stored.select("lang", "block", "part", "source", "p", "word", "bits")


def _meet(key, table):
    """Divergences of all pairs of sources of two sets over one block of terms."""
    lang, first, second = key[0].as_py(), key[2].as_py(), key[3].as_py()
    coded = table.column("source").combine_chunks().dictionary_encode()
    found = coded.dictionary.to_pylist()
    names = sorted(found)  # a pair is named in the same order in all blocks
    number = {name: i for i, name in enumerate(names)}
    code = np.array([number[name] for name in found], np.int64)[coded.indices.to_numpy()]
    p, word, part = (table.column(c).to_numpy() for c in ("p", "word", "part"))
    bits = table.column("bits").to_numpy()
    heads = word < 0  # one row a source: its probability of an absent term, and the block's number of terms
    absent, side = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    absent[code[heads]], side[code[heads]] = p[heads], part[heads]
    terms = int(bits[heads][0])
    order = np.lexsort((code, word))[int(heads.sum()):]
    code, p, word, bits = code[order], p[order], word[order], bits[order].view(np.uint64)
    joint = _present_in_both(code, p, word, bits, absent)
    one_sided = _present_in_one(code, p, np.bitwise_count(bits).astype(np.int64), absent)
    whole = joint + one_sided + one_sided.T + terms * _divergences(absent[:, None], absent[None, :])
    a, b = np.triu_indices(len(names), 1)
    if first != second:
        a, b = a[side[a] != side[b]], b[side[a] != side[b]]
    return pa.table(
        {
            "lang": pa.array([lang] * len(a), pa.string()),
            "a": pa.array([names[x] for x in a], pa.string()), "b": pa.array([names[x] for x in b], pa.string()),
            "value": pa.array(whole[a, b], pa.int64()),
        }
    )


def _present_in_both(code, p, word, bits, absent) -> np.ndarray:
    """Cells of two counts above zero, less what the one-sided and the empty cells count for the same terms."""
    found = np.zeros((len(absent), len(absent)), np.int64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    for low, high in zip(starts, np.append(starts[1:], len(word))):
        step = max(1, (1 << 20) // (high - low))
        for at in range(low, high, step):
            cells = np.bitwise_count(bits[at:min(at + step, high), None] & bits[None, low:high])
            i, j = np.nonzero(cells)
            number = cells[i, j].astype(np.int64)
            i, j = i + at, j + low
            apart = code[i] < code[j]
            i, j, number = i[apart], j[apart], number[apart]
            a, b = code[i], code[j]
            gain = (
                _divergences(p[i], p[j]) - _divergences(absent[a], p[j])
                - _divergences(p[i], absent[b]) + _divergences(absent[a], absent[b])
            )
            np.add.at(found, (a, b), number * gain)
    return found


def _present_in_one(code, p, number, absent) -> np.ndarray:
    """At (A, B): terms of B as if A had none of them, less the same terms as if neither had them."""
    found = np.zeros((len(absent), len(absent)), np.int64)
    if not len(code):
        return found
    order = np.lexsort((p, code))
    code, p, number = code[order], p[order], number[order]
    new = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(p, prepend=-1) != 0))
    number, code, p = np.add.reduceat(number, new), code[new], p[new]
    for a, without in enumerate(absent):
        np.add.at(found[a], code, number * (_divergences(without, p) - _divergences(without, absent[code])))
    return found


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top: int = 10
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) that occurs.

    Part ``pair``: the divergence from every other source of the language. Part ``term``: the ``top`` terms of the source that
    it has more often than its language, by their share of the divergence. Ranks go by value, then by name.

    Nulls are empty names and texts. Terms of fewer than ``least_docs`` documents of a language do not count; a
    language without terms has divergence 0. An empty table gives an empty result; only the three columns named are read.

    Counts combine in the tasks, so a hot source or a frequent term is one row a task. Terms are dealt into blocks
    and sources into sets; two sets meet over one block at a time, so neither a large vocabulary nor a
    language with very many sources is held in one place. The result itself has a row for each ordered pair of sources.
    """
    cells = once(term_counts(docs, text, lang, source))
    counted = cells.filter("term <> ''")
    kept = once(
        counted.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
        .filter(F.col("docs") >= least_docs).select("lang", "term", "in_lang")
    )
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total"))
    sources = cells.filter("term = ''").groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    langs = once(
        sources.join(sizes, "lang", "left").select(
            "lang", "sources", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")
        )
    )
    dealt = kept.join(langs, "lang").withColumn(
        "block", F.pmod(F.xxhash64("term"), F.ceil(F.col("terms") / BLOCK_TERMS)).cast("int")
    )
    inside = Window.partitionBy("lang", "block").orderBy("term")  # about BLOCK_TERMS rows
    vocabulary = once(
        dealt.select(
            "lang", "term", "block", (F.row_number().over(inside) - 1).alias("bit"),
            probability(F.col("in_lang"), F.col("lang_total"), F.col("terms")).alias("q"),
        )
    )
    present = once(counted.join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "block", "bit", "q"))
    totals = present.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = once(
        cells.filter("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang")
        .select(
            "lang", "source", "terms", F.coalesce("total", F.lit(0)).alias("total"),
            F.pmod(F.xxhash64("source"), F.ceil(F.col("sources") / SET_SOURCES)).cast("int").alias("part"),
            F.ceil(F.col("sources") / SET_SOURCES).cast("int").alias("parts"),
            F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1)).cast("int").alias("blocks"),
        )
    )
    placed = present.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "n", "block", "bit", "part", "q",
        probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
    )
    bitmaps = once(level_bitmaps(placed))
    in_block = vocabulary.groupBy("lang", "block").agg(F.count(F.lit(1)).alias("bits"))
    heads = (
        groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .join(in_block, ["lang", "block"], "left")
        .select(
            "lang", "block", "part", "source",
            F.coalesce(probability(F.lit(0), F.col("total"), F.col("terms")), F.lit(0)).alias("p"),
            F.lit(-1).alias("word"), F.coalesce("bits", F.lit(0)).alias("bits"),
        )
    )
    # every set of a language meets every other one, and itself
    sets = langs.select("lang", F.ceil(F.col("sources") / SET_SOURCES).cast("int").alias("parts"))
    sided = bitmaps.unionByName(heads).join(sets, "lang").withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    meeting = sided.select(
        "lang", "block", F.least("part", "other").alias("first"), F.greatest("part", "other").alias("second"),
        "part", "source", "p", "word", "bits",
    )
    pairs = once(
        meeting.groupBy("lang", "block", "first", "second")
        .applyInArrow(_meet, "lang string, a string, b string, value long")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    )
    both_ways = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                 F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair_rows = _ranked(pairs.select("lang", both_ways, "value"), "pair")
    own = placed.filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value")
    )
    term_rows = _ranked(own, "term").filter(F.col("rank") <= top)
    result = once(pair_rows.unionByName(term_rows))
    release(cells, kept, langs, vocabulary, present, groups, bitmaps, pairs)
    return result


def _ranked(found: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return found.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
