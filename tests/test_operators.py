"""Operators on tiny hand-made tables, and the rules for ties, missing values and sort orders."""

from __future__ import annotations

import math
import random
from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.stat import KernelDensity, Statistics
from pyspark.sql import functions as F

from panelwise.operators import cohorts, inference, panel, ranking, reshape, summary, timecourse
from panelwise.plans import study
from panelwise.sources import files, schemas, testviews


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- cohorts ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, "x", 1, None, 0, "red"), (2, "x", 0, 0, 0, "blue"), (3, "y", None, None, None, None),
        (4, "y", 0, 1, 1, "red"), (5, None, 1, 1, 1, "red"),
    ]
    return spark.createDataFrame(rows, "user_id int, cohort string, f1 int, f2 int, f3 int, colour string")


def test_membership_overlaps_and_sizes(people):
    members = cohorts.membership(people, "user_id", cohorts.labels("cohort", ["f1", "f2", "f3"]))
    assert rows_of(members, "cohort_label", "user_id") == [
        ("All x", 1), ("All x", 2), ("All y", 3), ("All y", 4), ("Dense x", 1), ("Dense y", 4),
    ]
    assert rows_of(cohorts.sizes(members, "user_id"), "cohort_label", "n_users") == [
        ("All x", 2), ("All y", 2), ("Dense x", 1), ("Dense y", 1),
    ]
    assert cohorts.with_prefix(members, "All").count() == 4


def test_set_operations(people):
    a, b = people.filter("user_id <= 3").select("user_id"), people.filter("user_id >= 3").select("user_id")
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(cohorts.intersect_users(a, b)) == [3]
    assert ids(cohorts.union_users(a, b)) == [1, 2, 3, 4, 5]
    assert ids(cohorts.subtract_users(a, b)) == [1, 2]
    assert cohorts.restrict(people, a, "user_id").count() == 3
    assert cohorts.exclude(people, a, "user_id").count() == 2
    assert cohorts.attach(people, a, "user_id").count() == 3


# --- reshape ---------------------------------------------------------------------------------------------


def test_name_patterns():
    names = ["user", "symptoms__a", "symptoms__b", "symptoms__none", "x"]
    picked = reshape.matching(names, contains="symptoms__", without=["symptoms__none"])
    assert picked == ["symptoms__a", "symptoms__b"]
    assert reshape.renamed(picked, "symptoms", "daily") == ["daily__a", "daily__b"]
    assert reshape.last_wins(["a", "b"], ["c", "a"]) == ["b", "c", "a"]


def test_melt_keeps_nulls_and_reindex_orders(spark, people):
    assert reshape.melt(people, ["user_id"], ["f1", "f2"]).count() == 10
    table = spark.createDataFrame([("a", 1), ("z", 2)], "label string, n int")
    assert rows_of(reshape.reindex(table, "label", ["b", "a"]), "label", "position") == [("a", 2)]
    assert rows_of(reshape.complete(table, "label", ["b", "a"]), "label", "n", "position") == [("a", 1, 2), ("b", None, 1)]
    stacked = reshape.all_rows(table, spark.createDataFrame([("q",)], "label string"))
    assert rows_of(stacked, "label", "n") == [("a", 1), ("q", None), ("z", 2)]


# --- summary ---------------------------------------------------------------------------------------------


def test_summary_table(people):
    labels = cohorts.labels("cohort", ["f1", "f2", "f3"])
    counted = study.answer_counts(people, labels, ["colour"], study.tidy_answer())
    table = summary.summary_table(counted, ["All x", "All y", "Dense y"], "count")
    assert rows_of(table, "value", "All x", "All y", "Dense y") == [
        ("Blue", "1 (50.0%)", "0 (0.0%)", "0 (0.0%)"),
        ("Red", "1 (50.0%)", "1 (50.0%)", "1 (100.0%)"),
        ("Unavailable", "0 (0.0%)", "1 (50.0%)", "0 (0.0%)"),
    ]
    sizes = cohorts.sizes(cohorts.membership(people, "user_id", labels), "user_id")
    assert summary.with_sizes(table, sizes, ["All x", "All y"]).columns[2:4] == ["All x (N=2)", "All y (N=2)"]
    wide = summary.contingency(counted, ["All x", "All y"])
    assert rows_of(wide, "value", "All x", "All y") == [("Blue", 1, 0), ("Red", 1, 1), ("Unavailable", 0, 1)]


def test_shares_add_up_and_do_not_depend_on_partitions(spark):
    random.seed(4)
    rows = [(random.choice("ab"), random.choice("pq"), random.choice("xyz")) for _ in range(500)]
    schema = "cohort_label string, variable string, value string"
    results = []
    for parts in (1, 7):
        random.shuffle(rows)
        counted = summary.counts(spark.createDataFrame(rows, schema).repartition(parts), ["cohort_label", "variable"])
        shares = summary.with_share(counted, ["cohort_label", "variable"])
        totals = shares.groupBy("cohort_label", "variable").agg(F.sum("percent").alias("t")).collect()
        assert all(r["t"] == pytest.approx(100) for r in totals)
        results.append(rows_of(shares, "cohort_label", "variable", "value", "n"))
    assert results[0] == results[1]


def test_missing_answers_fail_the_completeness_check(spark):
    long = spark.createDataFrame([("q", "a"), ("q", None), ("r", "a")], "variable string, value string")
    assert rows_of(summary.incomplete_groups(long, ["variable"]), "variable", "n_rows", "n_counted") == [("q", 2, 1)]


def test_condition_table_orders_by_prevalence_in_the_first_cohort(spark):
    people = spark.createDataFrame(
        [(1, "x", True, None), (2, "x", True, True), (3, "y", None, True)], "user_id int, cohort string, rare_one boolean, gerd boolean"
    )
    table = study.condition_table(
        people, F.array(F.concat(F.lit("All "), "cohort")), ["gerd", "rare_one"], ["All x", "All y"], {"Gerd": "GERD"}
    )
    assert [tuple(r) for r in table.orderBy("position").collect()] == [
        ("Rare One", 1, "2 (100.0%)", "0 (0.0%)"), ("GERD", 2, "1 (50.0%)", "1 (100.0%)"),
    ]


def test_care_location_rule_order(spark):
    # an answer with several places is "multiple" before the list of known places is looked at
    rows = spark.createDataFrame([("a",), ("a__b",), ("zz",), ("other",)], "v string")
    got = [r[0] for r in rows.select(study.care_location(F.col("v"), ["a", "multiple", "other"])).collect()]
    assert got == ["a", "multiple", "other", "other"]


# --- prefix sums, ranks, medians -------------------------------------------------------------------------


def test_running_totals_with_one_hot_group(spark):
    random.seed(1)
    rows = [("hot", i, random.randint(0, 5)) for i in range(3000)] + [(f"g{i % 7}", i, 1) for i in range(1000)]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(6)
    got = {(r["g"], r["o"]): r["v_upto"] for r in ranking.running_totals(df, ["o"], ["v"], ["g"]).collect()}
    assert len(got) == len(rows)
    sums = Counter()
    for g, o, v in sorted(rows):
        sums[g] += v
        assert got[(g, o)] == sums[g]


def test_row_numbers_are_global_and_keep_nulls(spark):
    rows = [(i, (i * 37) % 101) for i in range(101)] + [(200, None)]
    got = {r["k"]: r["n"] for r in ranking.row_numbers(spark.createDataFrame(rows, "k int, o int"), ["o"], "n").collect()}
    assert got.pop(200) is None
    assert all(got[k] == o + 1 for k, o in rows[:-1])


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_spread_median(spark, n):
    random.seed(n)
    values = [round(random.gauss(0, 1), 1) for _ in range(n)]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None)], "g string, v double")
    assert ranking.spread_median(df, ["g"], "v").collect()[0]["median"] == pytest.approx(float(np.median(values)))


@pytest.mark.parametrize("number", [10, 4000])
def test_user_ranks_keep_cohorts_in_blocks(spark, number):
    users = [(f"u{i:05d}", "ab"[i % 2], i) for i in range(number)]
    df = spark.createDataFrame(users, "user_id string, cohort string, d int").withColumn(
        "d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d"))
    )
    order = sorted(users, key=lambda u: (u[1] != "a", -u[2]))
    for offset in (3, 1000):
        got = ranking.oriented_ranks(df, "user_id", "d", "cohort", {"a": offset}).collect()
        assert {r["user_id"]: r["user_rank"] for r in got} == {u[0]: k + 1 for k, u in enumerate(order)}


# --- tests on tables -------------------------------------------------------------------------------------


def counts_frame(spark, matrix, question="q"):
    rows = [(question, f"r{i}", f"c{j}", int(n)) for i, row in enumerate(matrix) for j, n in enumerate(row) if n]
    return spark.createDataFrame(rows, "variable string, value string, cohort_label string, n long")


def test_chi_square_with_empty_cells_matches_the_built_in(spark):
    matrix = [[10, 0, 5], [3, 8, 0], [1, 2, 30], [0, 4, 4]]
    got = inference.chi_square(counts_frame(spark, matrix)).collect()[0]
    flat = [float(matrix[i][j]) for j in range(3) for i in range(4)]
    want = Statistics.chiSqTest(Matrices.dense(4, 3, flat))
    assert got["dof"] == want.degreesOfFreedom
    assert got["chi2"] == pytest.approx(want.statistic)
    assert got["p_value"] == pytest.approx(want.pValue, abs=1e-12)


def test_chi_square_of_large_counts_loses_no_digits(spark):
    million = 10**6
    full = [[10**12, 10**12 + million], [10**12 - million, 10**12], [10**12, 10**12 - 3 * million]]
    sparse = [[10**12, 10**12 + million, 0], [10**12 - million, 10**12, 7]]
    for matrix in (full, sparse):
        rows, cols = [sum(r) for r in matrix], [sum(c) for c in zip(*matrix)]
        total = sum(rows)
        want = sum(
            Fraction((o * total - r * c) ** 2, r * c * total) for r, line in zip(rows, matrix) for c, o in zip(cols, line)
        )
        got = inference.chi_square(counts_frame(spark, matrix)).collect()[0]
        assert got["chi2"] == pytest.approx(float(want), rel=1e-12)


def test_chi_square_leaves_out_answers_without_counts(spark):
    counts = counts_frame(spark, [[15, 5, 3], [5, 15, 4]])
    empty = spark.createDataFrame([("q", "r9", "c0", 0), ("q", "r9", "c1", 0)], counts.schema)
    got, want = (inference.chi_square(c).collect()[0] for c in (counts.union(empty), counts))
    assert (got["dof"], got["n_total"]) == (want["dof"], want["n_total"])
    assert got["chi2"] == pytest.approx(want["chi2"])


def test_chi_square_two_by_two_is_corrected(spark):
    # by hand: all expected counts 10, each |o - e| = 5 reduced to 4.5
    assert inference.chi_square(counts_frame(spark, [[15, 5], [5, 15]])).collect()[0]["chi2"] == pytest.approx(8.1)
    # a difference below one half is reduced to nothing
    assert inference.chi_square(counts_frame(spark, [[10, 10], [10, 10]])).collect()[0]["chi2"] == 0.0
    # an empty cell
    table = [[6, 0], [2, 4]]
    e = [[8 * 6 / 12, 4 * 6 / 12]] * 2
    want = sum((abs(table[i][j] - e[i][j]) - 0.5) ** 2 / e[i][j] for i in range(2) for j in range(2))
    assert inference.chi_square(counts_frame(spark, table)).collect()[0]["chi2"] == pytest.approx(want)


def test_threshold_is_divided_by_the_number_of_questions(spark):
    both = counts_frame(spark, [[30, 5], [5, 30]], "q").unionByName(counts_frame(spark, [[5, 5], [5, 6]], "r"))
    got = {r["variable"]: r for r in inference.chi_square(both).collect()}
    assert got["q"]["threshold"] == got["r"]["threshold"] == 0.025
    assert got["q"]["significant"] and not got["r"]["significant"]


def test_two_proportions_uses_set_sizes_and_the_union(spark):
    # user 1 is in both cohorts; user 9 in none, with an answer nobody else gave
    wide = spark.createDataFrame(
        [(1, ["a", "b"], "y"), (2, ["a"], "n"), (3, ["b"], "n"), (4, ["b"], "y"), (5, ["a"], None), (9, None, "odd")],
        "user_id int, labels array<string>, q string",
    )
    sizes = spark.createDataFrame([("a", 3), ("b", 3)], "cohort_label string, n_users long")
    got = {r["value"]: r for r in inference.two_proportions(wide, "labels", [("a", "b")], sizes, ["q"]).collect()}
    y = got["y"]
    assert (y["p1"], y["p2"], y["p_all"]) == pytest.approx((1 / 2, 2 / 3, 1 / 2))
    z = (1 / 2 - 2 / 3) / math.sqrt(0.25 * (1 / 3 + 1 / 3))
    assert y["z"] == pytest.approx(z) and y["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert (got["odd"]["p1"], got["odd"]["p2"], got["odd"]["z"], got["odd"]["p_value"]) == (0, 0, None, None)


def test_rank_sum_matches_brute_force(spark):
    random.seed(8)
    data = [(random.choice("abc"), random.choice([None, *range(9)])) for _ in range(300)]
    df = spark.createDataFrame(data, "g string, v int")
    got = {(r["cohort_a"], r["cohort_b"]): r for r in inference.rank_sum_pairs(df, "g", "v", ["a", "b", "c"]).collect()}
    for a, b in combinations("abc", 2):
        xs = [v for g, v in data if g == a and v is not None]
        ys = [v for g, v in data if g == b and v is not None]
        u = sum((x > y) + 0.5 * (x == y) for x in xs for y in ys)
        n = len(xs) + len(ys)
        ties = sum(t**3 - t for t in Counter(xs + ys).values())
        sd = math.sqrt(len(xs) * len(ys) / 12 * (n + 1 - ties / (n * (n - 1))))
        z = max(abs(u - len(xs) * len(ys) / 2) - 0.5, 0) / sd
        r = got[(a, b)]
        assert (r["n_a"], r["n_b"], r["u"]) == (len(xs), len(ys), u)
        other = sum((y > x) + 0.5 * (x == y) for x in xs for y in ys)
        assert r["u"] + other == len(xs) * len(ys)
        assert r["z"] == pytest.approx(z) and r["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_density_matches_the_built_in(spark):
    values = [1.0, 2.0, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None)], "g string, v double")
    curve = inference.kernel_density(df, "g", "v").orderBy("point").collect()
    width = float(np.std(values, ddof=1)) * 5 ** (-0.2)
    built_in = KernelDensity()
    built_in.setSample(spark.sparkContext.parallelize(values))
    built_in.setBandwidth(width)
    assert curve[0]["x"] == pytest.approx(1 - 3 * width) and curve[-1]["x"] == pytest.approx(9 + 3 * width)
    want = built_in.estimate([r["x"] for r in curve])
    np.testing.assert_allclose([r["density"] for r in curve], want, rtol=1e-9)


# --- time courses ----------------------------------------------------------------------------------------


def test_rolling_means_match_pandas(spark):
    random.seed(2)
    values = [random.random() for _ in range(12)]
    df = spark.createDataFrame([("a", d, v) for d, v in enumerate(values)], "g string, d int, v double")
    series = pd.Series(values)
    for before, after, want in (
        (4, 0, series.rolling(5).mean()), (2, 2, series.rolling(5, center=True).mean()), (2, 0, series.rolling(3).mean()),
    ):
        got = df.select("d", timecourse.rolling_mean(F.col("v"), ["g"], "d", before, after).alias("m")).orderBy("d")
        np.testing.assert_allclose([r["m"] if r["m"] is not None else np.nan for r in got.collect()], want, equal_nan=True)


def test_peak_is_missing_when_never_reported_and_earliest_on_ties(spark):
    rows = [("c", d, 0.0 if d < 0 else 1.0, None) for d in range(-10, 11)]
    df = spark.createDataFrame(rows, "cohort string, d int, flat double, never double")
    reports = timecourse.daily_reports(df, ["cohort"], "d", ["flat", "never"])
    totals = timecourse.daily_totals(reports, ["cohort"], "d", ["flat", "never"])
    centred = {r["variable"]: r["peak_day"] for r in timecourse.peak_days(totals, ["cohort"], "d", 2, 2).collect()}
    trailing = {r["variable"]: r["peak_day"] for r in timecourse.peak_days(totals, ["cohort"], "d", 4, 0).collect()}
    assert centred == {"flat": 2, "never": None}
    assert trailing == {"flat": 4, "never": None}


def test_prevalence_counts_missing_days_and_leaves_absent_cells_empty(spark):
    rows = [("a", 0, 1.0), ("a", 0, None), ("a", 1, None), ("b", 0, 1.0), (None, 0, 1.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "cohort string, d int, s double")
    got = study.prevalence_panels(df, "cohort", "d", ["s"], ["a", "b"], "a")
    assert rows_of(got, "d", "a", "b") == [(0, 50.0, 100.0), (1, 0.0, None)]


def test_elevated_rate_rules(spark):
    # z missing counts as not above; the mean runs before the cut; the bar uses the cohort's users
    z = {-12: [1.0, 1.0], -11: [1.0, None], -10: [-1.0, None], -9: [1.0, 1.0]}
    rows = [("c", f"u{i}", day, v) for day, values in z.items() for i, v in enumerate(values)] + [("c", "u9", None, 1.0)]
    df = spark.createDataFrame(rows, "cohort string, user_id string, d int, z double")
    got = timecourse.elevated_rate(df, "cohort", "d", "user_id", "z", [0.0, 1.0]).collect()
    low = {r["d"]: r for r in got if r["threshold"] == 0.0}
    assert sorted(low) == [-10, -9]
    assert low[-10]["share"] == pytest.approx((1 + 0.5 + 0) / 3)
    assert low[-10]["n_users"] == 3
    assert low[-10]["error_bar"] == pytest.approx(math.sqrt(0.5 * 0.5 / 3) / 2)
    assert sorted({r["expected"] for r in got}) == pytest.approx([0.15865525393145707, 0.5])
    assert all(r["share"] == 0 for r in got if r["threshold"] == 1.0)  # strictly above


# --- symptoms --------------------------------------------------------------------------------------------

SYMPTOM_SCHEMA = "user_id int, cohort string, symptoms__p string, symptoms__q string, symptoms__r string"


def test_symptom_sets_order_and_threshold(spark):
    present = {"p": ("p", None, None), "pq": ("p", "q", None), "": (None, None, None), "r": (None, None, "r")}
    sizes = {("p", "a"): 3, ("pq", "a"): 2, ("pq", "b"): 1, ("", "b"): 3, ("r", "b"): 1}
    rows = [(0, c, *present[s]) for (s, c), n in sizes.items() for _ in range(n)]
    events = spark.createDataFrame(rows, SYMPTOM_SCHEMA)
    combos = study.combination_counts(events, "cohort", ["symptoms__p", "symptoms__q", "symptoms__r"])
    top = study.top_symptoms(combos, "cohort", ["a", "b"], 1)
    assert rows_of(top, "symptom") == [("p",)]  # first name wins the tie in b
    got = study.symptom_sets(combos, "cohort", ["a", "b"], 2, min_share=0.15).orderBy("position").collect()
    # r is not among the top symptoms, so its row joins the empty set; total first, then size
    assert [(r["symptom_set"], r["total"], r["a"], r["b"]) for r in got] == [("", 4, 0, 4), ("p+q", 3, 2, 1), ("p", 3, 3, 0)]
    few = study.symptom_sets(combos, "cohort", ["a", "b"], 2, min_share=0.35)
    assert rows_of(few, "symptom_set", "total") == [("", 4)]


def test_symptom_summary_sorts_by_number(spark):
    counted = spark.createDataFrame(
        [("All a", "symptoms__p", "p", 9), ("All a", "symptoms__p", "", 91), ("All a", "symptoms__q", "q", 88), ("All a", "symptoms__q", "", 12),
         ("All a", "symptoms__r", "r", 100)],
        "cohort_label string, variable string, value string, n long",
    )
    peaks = spark.createDataFrame([("a", "p", 3), ("a", "q", None), ("a", "r", 1)], "cohort string, variable string, peak_day int")
    got = study.symptom_summary(counted, peaks, {"All a": "a"}, "cohort").orderBy("position").collect()
    assert [(r["symptom"], r["All a"], r["All a peak"]) for r in got] == [("r", "100.0%", "1"), ("q", "88.0%", "NA"), ("p", "9.0%", "3")]


def test_pooled_table_counts_present_only(spark):
    counted = spark.createDataFrame(
        [("c", "s1", "x", 4), ("c", "s1", "", 6), ("d", "s2", "x", 3)], "cohort_label string, variable string, value string, n long"
    )
    assert rows_of(study.pooled_presence(counted), "variable", "value", "cohort_label", "n") == [
        ("symptoms", "s1", "c", 4), ("symptoms", "s2", "d", 3),
    ]


# --- panels ----------------------------------------------------------------------------------------------


def test_contradictions_found_only_on_a_spoiled_panel(spark):
    schema = "valid_user__steps int, valid_day__steps int, steps__observed double"
    clean = spark.createDataFrame([(1, 1, 5.0), (1, 0, None), (0, 0, None)], schema)
    assert panel.contradicting_rows(clean, ["steps"]).count() == 0
    spoiled = clean.unionByName(spark.createDataFrame([(0, 0, 3.0), (1, 1, None), (1, 0, 2.0)], schema))
    assert panel.contradicting_rows(spoiled, ["steps"]).count() == 3
    assert sum(r["n_rows"] for r in panel.contradiction_counts(spoiled, ["steps"]).collect()) == 4


def test_view_panel_is_consistent(spark):
    assert panel.contradicting_rows(testviews.activity_panel(spark, "/root/testdata/sf0.001"), testviews.CHANNELS).count() == 0


def test_zscores_have_mean_zero_and_unit_spread(spark):
    random.seed(3)
    rows = [(i % 5, random.gauss(10, 3)) for i in range(200)] + [(7, 4.0), (8, 2.0), (8, 2.0), (1, None)]
    scored = panel.zscores(spark.createDataFrame(rows, "user_id int, v double"), "user_id", ["v"])
    assert scored.count() == len(rows)
    for r in scored.groupBy("user_id").agg(F.avg("v_z").alias("m"), F.stddev_samp("v_z").alias("s")).collect():
        if r["user_id"] < 5:
            assert r["m"] == pytest.approx(0, abs=1e-12) and r["s"] == pytest.approx(1)
        else:  # one row, or no spread
            assert r["m"] is None


def test_coverage_grid_day_types(spark):
    rows = [
        ("u1", "a", "2020-01-02", "2020-01-02", 0, 1, 0), ("u1", "a", "2020-01-03", "2020-01-02", 1, 1, 1),
        ("u1", "a", "2020-01-04", "2020-01-02", 2, 1, 0), ("u2", "a", "2020-01-03", "2020-01-02", 1, 0, 0),
        ("u3", None, "2020-01-03", None, None, 1, 1), ("u4", "b", "2020-01-03", None, None, 1, 1),
    ]
    df = spark.createDataFrame(
        rows, "user_id string, cohort string, study_date string, onset string, d int, valid_user__steps int, valid_day__steps int"
    ).withColumn("onset", F.to_date("onset"))
    got = panel.coverage_grid(df, "user_id", "cohort", "study_date", "onset", "d", ["steps"], {}, {"steps": "Steps"})
    assert rows_of(got, "user_id", "study_date", "user_rank", "channel", "day_type") == [
        ("u1", "2020-01-02", 1, "Steps", "Symptoms Onset"), ("u1", "2020-01-03", 1, "Steps", "a observation"),
        ("u1", "2020-01-04", 1, "Steps", "no observation"), ("u4", "2020-01-03", None, "Steps", None),
    ]


# --- files -----------------------------------------------------------------------------------------------


def test_csv_round_trip_and_missing_markers(spark, tmp_path):
    path = str(tmp_path / "plain.csv")
    with open(path, "w") as out:
        out.write("b,user_id,v\nNA,u1,1.5\n,u2,NaN\nx,u3,NA\n")
    schema = "user_id string, b string, v double"
    parsed = spark.createDataFrame([], schema).schema
    got = files.read_csv(spark, path, parsed, by_position=False)
    assert rows_of(got, "user_id", "b", "v") == [("u1", None, 1.5), ("u2", None, None), ("u3", "x", None)]
    again = str(tmp_path / "again")
    files.write_csv(got, again)
    assert rows_of(files.read_csv(spark, again, parsed), "user_id", "b", "v") == rows_of(got, "user_id", "b", "v")
    landed = files.land(got, str(tmp_path / "landed"))
    assert landed.schema == got.schema and landed.count() == 3


def test_csv_by_header_whole_numbers_and_markers(spark, tmp_path):
    path = str(tmp_path / "flags.csv")
    with open(path, "w") as out:
        out.write("flag,user_id\n1.0,u1\n-,u2\n0,u3\nNA,u4\n,u5\n")
    schema = spark.createDataFrame([], "user_id string, flag int").schema
    got = files.read_csv(spark, path, schema, missing=["NA", "-"])
    assert rows_of(got, "user_id", "flag") == [("u1", 1), ("u2", None), ("u3", 0), ("u4", None), ("u5", None)]
    with open(path, "a") as out:
        out.write("1.5,u6\n")
    with pytest.raises(Exception, match="no whole number"):
        files.read_csv(spark, path, schema, missing=["NA", "-"]).collect()
    with pytest.raises(ValueError):
        files.read_csv(spark, path, spark.createDataFrame([], "user_id string").schema, by_position=True)


def test_declared_schemas_have_unique_columns():
    for schema in (schemas.EVENTS_SURVEY, schemas.DAILY_SYMPTOMS, schemas.PARTICIPANTS, schemas.ACTIVITY_PANEL):
        assert len(set(schema.names)) == len(schema.names)


def test_zscores_with_one_user_holding_a_third_of_the_rows(spark):
    random.seed(6)
    rows = [("hot", random.gauss(0, 1)) for _ in range(2000)] + [(f"u{i % 400}", random.gauss(0, 1)) for i in range(4000)]
    frame = pd.DataFrame(rows, columns=["user_id", "v"])
    want = (frame["v"] - frame.groupby("user_id")["v"].transform("mean")) / frame.groupby("user_id")["v"].transform("std")
    got = panel.zscores(spark.createDataFrame(rows, "user_id string, v double").repartition(8), "user_id", ["v"])
    np.testing.assert_allclose(sorted(r["v_z"] for r in got.collect()), sorted(want))


def test_cut_keeps_rows_and_clusters(spark):
    from panelwise.session import cut

    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    written = cut(df, "k")
    assert rows_of(written, "k", "id") == rows_of(df, "k", "id")
    assert written.schema.names == ["k", "id"]
