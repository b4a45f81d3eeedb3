from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from panelwise.functions import numeric, tails, text


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in rows.select("i", expression(F.col("v")).alias("r")).orderBy("i").collect()]


def test_erfc_matches_the_library(spark):
    xs = [0.0, 1e-9, 0.1, 0.7, 1.3, 2.0, 2.4999, 2.5, 2.51, 3.0, 4.2, 6.0, 10.0, 26.0, 40.0]
    for x, got in zip(xs, column(spark, xs, "double", tails.erfc)):
        assert got == pytest.approx(math.erfc(x), rel=1e-11, abs=1e-300)


def test_normal_tails(spark):
    zs = [-1.959963984540054, 0.0, 1.959963984540054, None]
    two = column(spark, zs, "double", tails.normal_two_sided)
    upper = column(spark, zs, "double", tails.normal_upper)
    assert two[:3] == pytest.approx([0.05, 1.0, 0.05]) and two[3] is None
    assert upper[:3] == pytest.approx([0.975, 0.5, 0.025]) and upper[3] is None


def test_chi_square_tail_at_tabled_values(spark):
    # tabled 5% points
    table = {1: 3.841459, 2: 5.991465, 3: 7.814728, 4: 9.487729, 5: 11.070498, 10: 18.307038, 30: 43.772972, 100: 124.342113}
    rows = spark.createDataFrame([(k, x) for k, x in table.items()], "k int, x double")
    got = rows.select(tails.chi_square_upper(F.col("x"), F.col("k")).alias("p")).collect()
    assert all(r["p"] == pytest.approx(0.05, abs=2e-7) for r in got)


def test_chi_square_tail_at_extremes(spark):
    rows = spark.createDataFrame([(0.0, 3), (5.0, 0), (1e5, 2), (2000.0, 2000), (None, 2)], "x double, k int")
    p = [r["p"] for r in rows.select(tails.chi_square_upper(F.col("x"), F.col("k")).alias("p")).collect()]
    assert p[0] == 1.0 and p[1] == 1.0 and p[2] == 0.0 and p[4] is None
    assert 0.48 < p[3] < 0.51  # no underflow with many degrees of freedom


def test_title_case_is_pythons(spark):
    samples = [
        "i'd prefer not to answer", "trade/technical/vocational training", "4-not specified", "ABC dEF", "", "a",
        "white / caucasian", "doctorate degree, md", "x1y2z", "  two  spaces ", "élan vital",
    ]
    assert column(spark, samples, "string", text.title_case) == [s.title() for s in samples]


def test_last_part(spark):
    assert column(spark, ["a__b", "a", "a__b__c", None], "string", text.last_part) == ["b", "a", "c", None]


def test_recode_keeps_other_values(spark):
    got = column(spark, ["yes", "maybe", None], "string", lambda v: text.recode(v, {"yes": "Yes"}))
    assert got == ["Yes", "maybe", None]


def test_percent_text_rounds_half_even(spark):
    got = column(spark, [12.25, 12.35, 100.0, 0.0], "double", text.percent_text)
    assert got == ["12.2%", "12.4%", "100.0%", "0.0%"]


def test_null_rules(spark):
    nan = float("nan")
    assert column(spark, [1.0, None, nan, -1.0], "double", lambda v: numeric.above(v, 0)) == [True, False, False, False]
    assert column(spark, [1.0, nan, None], "double", numeric.nan_to_null) == [1.0, None, None]
    assert column(spark, [0.0, 2.0], "double", lambda v: numeric.ratio(F.lit(1), v)) == [None, 0.5]
    rows = spark.createDataFrame([("a", None), ("b", 2)], "k string, v int")
    assert dict(rows.groupBy("k").agg(numeric.total(F.col("v"))).collect()) == {"a": 0, "b": 2}
    flags = spark.createDataFrame([(True, None), (None, None), (False, True)], "a boolean, b boolean")
    got = [r[0] for r in flags.select(numeric.any_true([F.col("a"), F.col("b")])).collect()]
    assert got == [True, False, True]
