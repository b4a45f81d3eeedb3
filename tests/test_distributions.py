"""Medians by histograms, checked counts, exact rank tests and binned densities against plain definitions."""

from __future__ import annotations

import itertools
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import inference, reshape, selection, summary
from panelwise.plans import study

SCHEMA = "label string, question string, value double"


def hard_groups() -> dict[str, list[float]]:
    pick = random.Random(17)
    return {
        "one": [3.5], "two": [1.0, 2.0], "equal": [7.25] * 50, "nearly": [1.0] * 40 + [2.0],
        "even split": [1.0] * 10 + [2.0] * 10, "tail": [pick.random() for _ in range(301)] + [1e300, -1e300],
        "powers": [2.0**k for k in range(-300, 300)], "wide": [-1.7e308, 1.7e308, 0.0, 1.0],
        "cents": [round(pick.uniform(-999, 9999), 2) for _ in range(2000)], "negative": [-5.0, -1.0, -2.0, -9.0, -9.0],
        "close": [1.0 + k * 2**-52 for k in range(7)], "signs": [0.0, -0.0, 5e-324, -5e-324, 1.0],
    }


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_medians_of_all_groups_together(spark, bins):
    groups = hard_groups()
    if bins < 1024:  # such rounds are many where values go through hundreds of powers of two
        groups = {k: v for k, v in groups.items() if k not in ("powers", "tail")}
    rows = [(g, "q", v) for g, values in groups.items() for v in values]
    rows += [("one", "q", None), ("two", "q", float("nan")), ("two", "q", float("inf")), (None, "q", 1.0), ("empty", "q", None)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r["label"]: (r["n"], r["median"]) for r in selection.medians(frame, ["label", "question"], "value", bins).collect()}
    assert got == {g: (len(v), statistics.median(v)) for g, v in groups.items()}


def test_continuous_table(spark):
    rows = [("All a", "x", v) for v in (1.0, 2.0, 4.0, 8.0)] + [("Dense a", "x", v) for v in (2.0, 4.0, 8.0)]
    rows += [("All b", "x", 5.5), ("All a", "y", None), ("other", "x", 1.0), ("All b", "y", 0.123456789)]
    table = summary.continuous_table(
        spark.createDataFrame(rows, SCHEMA), ["All a", "Dense a", "All b"], "label", "question"
    )
    got = {(r["question"], r["statistic"]): (r["All a"], r["Dense a"], r["All b"]) for r in table.collect()}
    assert got == {
        ("x", "Mean ± SD"): ("3.8 ± 3.1", "4.7 ± 3.1", "5.5 ± NaN"), ("x", "Median"): ("3.0", "4.0", "5.5"),
        ("x", "Min - Max"): ("1.0 - 8.0", "2.0 - 8.0", "5.5 - 5.5"), ("y", "Mean ± SD"): (None, None, "0.1 ± NaN"),
        ("y", "Median"): (None, None, "0.123456789"), ("y", "Min - Max"): (None, None, "0.123456789 - 0.123456789"),
    }


def test_counts_that_do_not_add_up_are_refused(spark):
    rows = [("c", "q1", "yes"), ("c", "q1", "no"), ("c", "q2", None), ("c", "q2", "yes"), ("d", "q2", None), ("c", "q2", None)]
    long = spark.createDataFrame(rows, "cohort string, variable string, value string")
    by = ["cohort", "variable"]
    with pytest.raises(summary.IncompleteAnswers, match=r"3 answers in 6 rows; without an answer: c, q2: 2; d, q2: 1"):
        summary.complete_counts(long, by)
    filled = summary.complete_counts(long, by, clean=study.tidy_answer())
    assert {(r["cohort"], r["variable"], r["value"]): r["n"] for r in filled.collect()} == {
        ("c", "q1", "Yes"): 1, ("c", "q1", "No"): 1, ("c", "q2", "Unavailable"): 2, ("c", "q2", "Yes"): 1,
        ("d", "q2", "Unavailable"): 1,
    }
    with pytest.raises(summary.IncompleteAnswers):
        summary.complete_counts(long, by, clean=lambda a: F.when(a == "yes", a))
    assert summary.complete_counts(long.limit(0), by).collect() == []


@pytest.mark.parametrize("a", range(1, 7))
def test_exact_rank_test_equals_enumeration(a):
    for b in range(a, 13 - a):
        seen = [sum(c) + a - a * (a + 1) // 2 for c in itertools.combinations(range(a + b), a)]
        for u in range(a * b + 1):
            far = max(u, a * b - u)
            expected = min(1.0, 2 * sum(x >= far for x in seen) / len(seen))
            assert inference.exact_rank_sum_p(float(u), a, b) == pytest.approx(expected, rel=1e-12)
            assert inference.exact_rank_sum_p(float(u), b, a) == pytest.approx(expected, rel=1e-12)


def test_small_untied_pairs_get_the_exact_value(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0)] + [("b", v) for v in (4.0, 5.0, 6.0, 7.0)] + [("c", v) for v in (1.0, 9.0)]
    rows += [("d", float(v) + 0.5) for v in range(40)] + [("e", float(v) + 0.25) for v in range(9)]
    frame = spark.createDataFrame(rows, "cohort string, value double")
    get = lambda **how: {
        (r["cohort_a"], r["cohort_b"]): r for r in inference.rank_sum_pairs(frame, "cohort", "value", list("abcde"), **how).collect()
    }
    plain, exact = get(), get(small=8)
    assert exact["a", "b"]["p_value"] == pytest.approx(2 / 35)
    assert exact["a", "b"]["u"] == plain["a", "b"]["u"] and exact["a", "b"]["z"] == plain["a", "b"]["z"]
    assert exact["a", "c"]["p_value"] == plain["a", "c"]["p_value"]  # a tie
    assert exact["d", "e"]["p_value"] == plain["d", "e"]["p_value"]  # nine and more members a side
    assert exact["b", "d"]["p_value"] != plain["b", "d"]["p_value"]
    assert get(small=8, cells=100)["b", "d"]["p_value"] == plain["b", "d"]["p_value"]


def test_binned_density_is_within_its_error(spark):
    rng = np.random.default_rng(12)
    held = {"wide": rng.normal(50, 10, 700), "two hills": np.concatenate([rng.normal(0, 1, 300), rng.normal(9, 2, 400)])}
    rows = [(g, float(v)) for g, values in held.items() for v in values] + [("flat", 2.0), ("flat", 2.0), ("wide", None), ("wide", float("nan"))]
    frame = spark.createDataFrame(rows, "cohort string, value double")
    for cells in (64, 1024):
        got = inference.binned_density(frame, "cohort", "value", cells=cells).collect()
        assert {r["cohort"] for r in got} == set(held)
        for g, values in held.items():
            h = values.std(ddof=1) * len(values) ** -0.2
            d = (values.max() - values.min()) / (cells - 1)
            mine = sorted((r for r in got if r["cohort"] == g), key=lambda r: r["point"])
            assert len(mine) == 200
            for r in mine:
                direct = np.exp(-((r["x"] - values) ** 2) / (2 * h * h)).sum() / (len(values) * h * math.sqrt(2 * math.pi))
                assert abs(r["density"] - direct) <= 0.05 * (d / h) ** 2 / h + 1e-12


def test_places_in_a_fixed_order(spark):
    frame = spark.createDataFrame([("b",), ("z",), (None,), ("a",)], "kind string")
    got = {r["kind"]: r["at"] for r in reshape.with_position(frame, "kind", ["b", "a"], "at").collect()}
    assert got == {"b": 1, "a": 2, "z": 3, None: None}
