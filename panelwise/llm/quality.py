"""Quality rules: text statistics, and robust outliers per language and source.

The minimum covariance determinant is found by concentration steps: from a start of medians and quartiles, each
step takes the share of a group's rows that are nearest by Mahalanobis distance and refits mean and covariance.
Distances are put into fine bins of their logarithm, whose counts and moments are plain sums; so a step is one
aggregate with partial sums, however large a group is, and the nearest share is whole bins.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.llm import hashing
from panelwise.llm.common import any_names, carries, flat, once, rows, utf8
from panelwise.session import cut

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
FEATURES = ["x0", "x1", "x2", "x3", "x4"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def count_statistics(data: np.ndarray, borders: np.ndarray, window: int = 8) -> list[np.ndarray]:
    """The numbers of ``COUNTS`` for every text ``data[borders[i]:borders[i + 1]]``."""
    texts = len(borders) - 1
    between = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[borders])
    count = lambda owner: np.bincount(owner, minlength=texts)
    inside = ~hashing.SPACE[data]
    start, stop, owner = hashing.words(data, borders)
    slices = hashing.Slices(data)

    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(borders[:-1], breaks + 1)
    line_start = line_start[line_start < len(data)] if len(data) else line_start[:0]
    line_owner = np.searchsorted(borders, line_start, side="right") - 1
    # a break at the end of a text opens an empty line that belongs to no text after it
    after = np.searchsorted(breaks, line_start, side="left")
    next_break = np.append(breaks, len(data))[after]
    line_stop = np.minimum(next_break, borders[line_owner + 1]) if len(line_start) else line_start
    filled = np.concatenate([[0], np.cumsum(inside)])
    spoken = filled[line_stop] > filled[line_start]
    line_start, line_stop, line_owner = line_start[spoken], line_stop[spoken], line_owner[spoken]
    lines = hashing.within(slices.of(line_start, line_stop), line_owner)
    first = np.unique(lines, return_index=True)[1]
    n_lines = count(line_owner)

    grams = hashing.runs(slices.of(start, stop), window)
    whole = np.flatnonzero(owner[: len(grams)] == owner[window - 1:]) if len(grams) else np.zeros(0, np.int64)
    _, inverse, times = np.unique(
        hashing.within(grams[whole], owner[whole]), return_inverse=True, return_counts=True
    )
    again = whole[times[inverse] > 1] if len(whole) else whole
    cover = np.zeros(len(start) + 1, np.int64)
    cover[again] += 1
    cover[again + window] -= 1
    repeated = np.cumsum(cover[:-1]) > 0

    return [
        count(owner), between(inside & ((data & 0xC0) != 0x80)), between(_SYMBOL[data]),
        n_lines - count(line_owner[first]), count(owner[repeated]), n_lines, between((data >= 65) & (data <= 90)),
    ]


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) plus the counts of ``COUNTS``; a null text has none of anything."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in COUNTS]
    own = [] if carries(docs, text, kept) else [utf8(text).alias("_text")]
    read = "_text" if own else text

    def run(batches):
        for batch in rows(batches, read):
            counts = count_statistics(*flat(batch.column(batch.schema.get_field_index(read))))
            columns = [batch.column(k) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(c, pa.int64()) for c in counts], names=[*kept, *COUNTS]
            )

    chosen = docs.select(*[F.col(f"`{c}`") for c in kept], *own)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name in kept]
    return chosen.mapInArrow(run, ", ".join(fields + [f"{c} long" for c in COUNTS]))


def features() -> dict[str, Column]:
    """The statistics as five numbers: word length, symbols, repeated lines, repeated words, upper case."""
    n = F.col("n_words")
    return {
        "x0": F.log((F.col("word_chars") + 1) / (n + 1)),
        "x1": F.log1p(F.col("n_symbols") / (n + 1)),
        "x2": F.col("n_dup_lines") / (F.col("n_lines") + 4),
        "x3": F.col("n_repeat_words") / (n + 8),
        "x4": F.sqrt(F.col("n_upper") / (F.col("word_chars") + 1)),
    }


def chi_square_below(x: float, freedom: int) -> float:
    """Distribution function of chi-square, by its series."""
    term = total = 1.0 / (freedom / 2)
    for k in range(1, 200):
        term *= (x / 2) / (freedom / 2 + k)
        total += term
    return total * math.exp(-x / 2 + freedom / 2 * math.log(x / 2) - math.lgamma(freedom / 2))


def consistency(share: float, freedom: int) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal rows that of all rows."""
    low, high = 1e-9, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_below(middle, freedom) < share else (low, middle)
    return share / chi_square_below(low, freedom + 2)


def _distance(center: str = "center", inverse: str = "inverse") -> Column:
    total = F.lit(0.0)
    for k, (i, j) in enumerate(_PAIRS):
        left = F.col(FEATURES[i]) - F.col(center)[i]
        right = F.col(FEATURES[j]) - F.col(center)[j]
        total = total + (1.0 if i == j else 2.0) * left * right * F.col(inverse)[k]
    return total


def _start(measured: DataFrame, groups: list[str], floor: list[float], fine: int = 256) -> DataFrame:
    """Binned medians and quartile widths of every group: a start that outliers hardly move."""
    places = F.explode(
        F.array(*[
            F.struct(F.lit(k).alias("k"), F.floor(F.col(x) * fine).alias("bin")) for k, x in enumerate(FEATURES)
        ])
    )
    bins = measured.select(*groups, places.alias("p")).groupBy(*groups, "p.k", "p.bin").agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy(*groups, "k")
    upto = F.sum("n").over(window.orderBy("bin"))
    ranked = bins.select("*", upto.alias("upto"), F.sum("n").over(window).alias("all"))
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("all"), F.col("bin") / fine))
    quartiles = ranked.groupBy(*groups, "k").agg(
        at(0.5).alias("middle"), at(0.25).alias("low"), at(0.75).alias("high"), F.first("all").alias("rows")
    )
    floors = F.array(*[F.lit(float(x)) for x in floor])
    width = (F.col("high") - F.col("low")) / 1.349
    spread = quartiles.select(
        *groups, "rows", "k", "middle", (1.0 / (width * width + floors[F.col("k")] ** 2)).alias("weight")
    )
    ordered = spread.groupBy(*groups, "rows").agg(F.array_sort(F.collect_list(F.struct("k", "middle", "weight"))).alias("p"))
    weights = [F.col("p")[i]["weight"] if i == j else F.lit(0.0) for i, j in _PAIRS]
    return ordered.select(
        *groups, "rows", F.transform("p", lambda p: p["middle"]).alias("center"), F.array(*weights).alias("inverse")
    )


def _concentrate(
    measured: DataFrame, models: DataFrame, groups: list[str], share: float, floor: list[float], fine: int = 8
) -> DataFrame:
    """One step: mean and covariance of the nearest ``share`` of every group's rows, in whole bins of distance."""
    near = measured.join(models, groups).withColumn("_bin", F.floor(fine * F.log2(_distance() + 1e-9)))
    sums = [F.sum(x).alias(f"s{k}") for k, x in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{k}") for k, (i, j) in enumerate(_PAIRS)]
    bins = near.groupBy(*groups, "rows", "_bin").agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    before = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    inner = bins.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(
        F.col("_before") < share * F.col("rows")
    )
    names = ["n", *[f"s{k}" for k in range(len(FEATURES))], *[f"p{k}" for k in range(len(_PAIRS))]]
    moments = inner.groupBy(*groups, "rows").agg(*[F.sum(c).alias(c) for c in names])
    scale, mean = consistency(share, len(FEATURES)), lambda c: F.col(c) / F.col("n")
    spread = [scale * (mean(f"p{k}") - mean(f"s{i}") * mean(f"s{j}")) for k, (i, j) in enumerate(_PAIRS)]
    center = F.array(*[mean(f"s{k}") for k in range(len(FEATURES))])
    return _invert(moments.select(*groups, "rows", center.alias("center"), F.array(*spread).alias("spread")), floor)


def _invert(models: DataFrame, floor: list[float]) -> DataFrame:
    """``models`` plus ``inverse``: that of the covariance ``spread`` with ``floor`` added to every deviation."""
    size = len(FEATURES)

    def run(frames):
        for frame in frames:
            inverses = []
            for values in frame["spread"]:
                spread = np.zeros((size, size))
                for k, (i, j) in enumerate(_PAIRS):
                    spread[i, j] = spread[j, i] = values[k]
                inverse = np.linalg.inv(spread + np.diag(np.square(floor)))
                inverses.append([float(inverse[i, j]) for i, j in _PAIRS])
            yield frame.assign(inverse=inverses)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in models.schema)
    return models.mapInPandas(run, schema + ", inverse array<double>")


def _levels(passed: DataFrame, groups: list[str]) -> DataFrame:
    """Every row once per level: ``_level`` 0 is all rows, each further one keeps one more of the ``groups``."""
    keys = [
        F.struct(F.lit(n).alias("_level"), *[(F.col(g) if k < n else F.lit("")).alias(g) for k, g in enumerate(groups)])
        for n in range(len(groups) + 1)
    ]
    return passed.select(F.explode(F.array(*keys)).alias("_key"), *FEATURES).select("_key.*", *FEATURES)


def _shrink(models: DataFrame, groups: list[str], prior_rows: float) -> DataFrame:
    """The models of the narrowest level, each level drawn to the one above it as if that had ``prior_rows`` rows."""
    above = models.filter(F.col("_level") == 0)
    share = F.col("rows") / (F.col("rows") + prior_rows)
    for n in range(1, len(groups) + 1):
        keys = ["_level", *groups[:n - 1]]
        wide = above.select(
            (F.col("_level") + 1).alias("_level"), *groups[:n - 1], F.col("center").alias("_c"), F.col("spread").alias("_s")
        )
        drawn = lambda own, far: F.zip_with(own, far, lambda a, b: share * a + (1 - share) * b).alias(own)
        above = models.filter(F.col("_level") == n).join(wide, keys).select(
            "_level", *groups, "rows", drawn("center", "_c"), drawn("spread", "_s")
        )
    return above.select(*groups, "rows", "center", "spread")


@any_names
def judge(
    docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source"), keep: list[str] | None = None,
    share: float = 0.75, steps: int = 6, cutoff: float = 12.83, prior_rows: float = 50.0,
    floor: tuple[float, ...] = (0.05, 0.05, 0.05, 0.075, 0.05), min_words: int = 20, max_repeat: int = 30,
) -> DataFrame:
    """``docs`` (all columns, or those in ``keep``) plus the counts, ``base_failed``, ``distance`` and ``kept``.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat`` percent of words in repeated
    windows. Other rows are kept if their squared Mahalanobis distance from their group's robust centre is at
    most ``cutoff`` (for five normal features, one row in 40 lies beyond 12.83). Groups are the values of ``by``,
    null being a value of its own. ``floor`` is added to every feature's deviation: symbols and repeats are zero in
    most texts, so that their covariance is singular and the floor alone is their scale; above about 0.2 symbols a
    word or 27 percent of repeated words, a text is rejected for this alone where the centre is 0.

    The estimates use rows that passed the base rules. A group's centre and covariance are drawn to those of all
    rows with its first value of ``by``, and so on up to the whole table's, the wider estimate counting as
    ``prior_rows`` rows: a large group keeps its own, a small one gets mostly the wider one, and every row that
    passed the base rules is judged. Where no row of a group passed, the distance is null. A null text has no
    words and fails. Columns of ``docs`` with the new names are replaced; an empty table gives an empty result.
    """
    new = [*COUNTS, *FEATURES, "base_failed", "distance", "kept"]
    carried = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    groups = [f"_by{k}" for k in range(len(by))]
    # a text that is carried goes to the tasks once
    own = [] if carries(docs, text, carried) else [utf8(text).alias("_text")]
    # a group's key is text that tells null from every value
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in carried], *own,
        *[
            F.coalesce(F.concat(F.lit("="), F.col(f"`{b}`").cast("string")), F.lit("")).alias(g)
            for b, g in zip(by, groups)
        ],
    )
    counted = statistics(keyed, "_text" if own else text, [*carried, *groups])
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    measured = once(counted.withColumns(features()).withColumn("base_failed", failed))
    passed = _levels(measured.filter(~F.col("base_failed")), groups)
    levels = ["_level", *groups]
    models = cut(_start(passed, levels, list(floor)))
    for _ in range(steps):
        # written each time: one row per group, read by a join that Spark may broadcast by its known size
        models = cut(_concentrate(passed, models, levels, share, list(floor)))
    models = cut(_invert(_shrink(models, groups, prior_rows), list(floor)))
    scored = measured.join(models.select(*groups, "center", "inverse"), groups, "left").withColumn("distance", _distance())
    return scored.select(
        *carried, *COUNTS, "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))).alias("kept"),
    )
