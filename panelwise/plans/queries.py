"""Registered queries: every operator over the whole test views."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.functions.numeric import ratio, row_total, total
from panelwise.functions.text import last_part, recode
from panelwise.operators import cohorts, inference, mixed, panel, ranking, reshape, summary, timecourse
from panelwise.plans import study
from panelwise.session import cut, new_path
from panelwise.sources import files
from panelwise.sources import testviews as tv

USER, COHORT, DAY = "user_id", "cohort", "days_since_onset"
CHANNELS = tv.CHANNELS
VALID = [f"valid_user__{c}" for c in CHANNELS]
SYMPTOMS = [f"symptoms__{s}" for s in tv.SYMPTOMS]
ITEMS = [f"daily_symp__{i}" for i in [*tv.DAILY_ITEMS, "never"]]
QUESTIONS = ["area", "segment", "priority", "balance_group"]
CARE = ["care_cleaned", "hospitalized"]
CONDITIONS = ["cond_a", "cond_b", "cond_ab", "cond_any"]
ALL = [f"All {c}" for c in tv.COHORTS]
DENSE = [f"Dense {c}" for c in tv.COHORTS]
ACTIVITY = ("Dense Activity", "Non-dense Activity")
PAIRS = [(a, b) for i, a in enumerate(ALL) for b in ALL[i + 1:]]
KNOWN_PLACES = ["a", "n", "multiple", "unavailable", "other"]
PLACE_NAMES = {
    "a": "Place A", "n": "Place N", "multiple": "Multiple locations", "unavailable": "Unavailable", "other": "Other",
    "yes": "Yes", "no": "No",
}
OFFSETS = {"alpha": 1000, "beta": 2000}
STATES = {"steps": "state__steps__scale1k", "heart": "state__heart", "sleep": "state__sleep__scale60"}
THRESHOLDS = [0.0, 0.5, 1.0]


def _r(column: str | Column, name: str | None = None, places: int = 6) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, places).alias(name or column)


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- sources ---------------------------------------------------------------------------------------------


def scan_csv(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.events_survey(spark, d).select(
        USER, COHORT, "date_onset", "date_recovery", "care_where", "hospitalized", "symptoms__economy"
    )
    path = new_path(spark, "scan_csv")
    files.write_csv(rows, path)
    return files.read_csv(spark, path, rows.schema)


def scan_csv_by_name(spark: SparkSession, d: str) -> DataFrame:
    """The columns stand in another order in the file."""
    rows = tv.events_survey(spark, d).select(USER, COHORT, "date_onset", "care_where", "hospitalized")
    path = new_path(spark, "scan_csv_by_name")
    files.write_csv(rows.select(*reversed(rows.columns)), path)
    return files.read_csv(spark, path, rows.schema)


def preview(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.participants(spark, d).select(USER, COHORT, "area", "segment")
    first, last = files.first_rows(rows, [USER]), files.last_rows(rows, [USER])
    return reshape.all_rows(
        first.withColumn("part", F.lit("head")), last.withColumn("part", F.lit("tail"))
    )


# --- projections, predicates, conditional columns --------------------------------------------------------


def select_cols(spark: SparkSession, d: str) -> DataFrame:
    return tv.participants(spark, d).select(USER, COHORT, "area", "segment", "priority")


def select_pattern(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.events_survey(spark, d)
    return rows.select(USER, *reshape.matching(rows.columns, contains="symptoms__", without=["symptoms__promo"]))


def derived_names(spark: SparkSession, d: str) -> DataFrame:
    """A list of columns under names made from their own."""
    rows = tv.events_survey(spark, d)
    return rows.select(
        USER, *[F.col(old).alias(new) for old, new in zip(SYMPTOMS, reshape.renamed(SYMPTOMS, "symptoms__", "felt "))]
    )


def rename_map(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.events_survey(spark, d).select(USER, *SYMPTOMS)
    return reshape.rename(rows, {s: s.split("__")[-1] for s in SYMPTOMS})


def recode_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.events_survey(spark, d)
    return rows.select(
        USER, recode(F.col("care_where"), {"a": "Place A", "n": "Place N"}).alias("care"),
        recode(F.col("hospitalized"), {"yes": "Yes", "no": "No"}).alias("hospitalized"),
    )


def filter_eq(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.activity_panel(spark, d)
    kept = rows.filter((F.col(COHORT) == "alpha") & (F.col("flu_period") == "baseline"))
    return kept.select(USER, "study_date", DAY)


def filter_in(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.events_survey(spark, d)
    kept = rows.filter(F.col(COHORT).isin("alpha", "beta") & ~F.col("care_where").isin("a", "n", "unavailable"))
    return kept.select(USER, COHORT, "care_where")


def null_flags(spark: SparkSession, d: str) -> DataFrame:
    return study.presence(tv.events_survey(spark, d), [USER, COHORT], SYMPTOMS)


def filter_range(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.activity_panel(spark, d).filter(F.col(DAY).between(-10, 20))
    return rows.select(USER, DAY, "valid_day__steps")


def filter_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.activity_panel(spark, d).filter(F.col("steps__observed") > 50.0)
    return rows.select(USER, "study_date", _r("steps__observed"))


def filter_any_flag(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.participants(spark, d)
    any_flag = (F.col(VALID[0]) == 1) | (F.col(VALID[1]) == 1) | (F.col(VALID[2]) == 1)
    return rows.filter(any_flag).select(USER, COHORT, *VALID)


def fill_nulls(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.participants(spark, d).select(USER, "segment", "balance_group", "cond_a", *VALID)
    filled = rows.na.fill("Unavailable", ["segment", "balance_group"]).na.fill(0, VALID)
    return filled.na.fill(False, ["cond_a"])


def dense_users(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.participants(spark, d)
    streams = row_total([F.col(f) for f in VALID])
    return rows.filter(cohorts.any_valid(VALID)).select(USER, streams.alias("n_streams")).distinct()


def care_location_clean(spark: SparkSession, d: str) -> DataFrame:
    return _care(spark, d).groupBy("care_cleaned").agg(F.count(F.lit(1)).alias("n"))


def _care(spark: SparkSession, d: str) -> DataFrame:
    cleaned = study.care_location(F.col("care_where"), KNOWN_PLACES)
    return tv.events_survey(spark, d).withColumn("care_cleaned", cleaned)


def panel_consistency(spark: SparkSession, d: str) -> DataFrame:
    return panel.contradiction_counts(tv.unchecked_panel(spark, d), CHANNELS)


# --- reshaping -------------------------------------------------------------------------------------------


def melt_long(spark: SparkSession, d: str) -> DataFrame:
    return reshape.melt(tv.events_survey(spark, d), [USER], SYMPTOMS)


def split_name(spark: SparkSession, d: str) -> DataFrame:
    long = reshape.melt(tv.participants(spark, d), [USER], VALID, "channel", "user_validity")
    return long.withColumn("channel", last_part(F.col("channel")))


def pivot_cohort(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.activity_panel(spark, d).select(COHORT, DAY)
    return reshape.side_by_side(rows, [DAY], COHORT, tv.COHORTS, F.count(F.lit(1)))


# --- cohorts ---------------------------------------------------------------------------------------------


def _labels() -> Column:
    return cohorts.labels(COHORT, VALID)


def _full() -> Column:
    return _full_of(_labels())


def _full_of(labels: str | Column = "labels") -> Column:
    return F.filter(labels, lambda label: label.startswith("All"))


def _members(people: DataFrame) -> DataFrame:
    return cohorts.membership(people, USER, _labels())


def _labelled(rows: DataFrame, people: DataFrame) -> DataFrame:
    return study.with_labels(rows, people, USER, _labels())


def cohort_sizes(spark: SparkSession, d: str) -> DataFrame:
    return cohorts.sizes(_members(tv.participants(spark, d)), USER)


def semi_cohort(spark: SparkSession, d: str) -> DataFrame:
    dense = _members(tv.participants(spark, d)).filter(F.col("cohort_label") == "Dense alpha")
    return cohorts.restrict(tv.events_survey(spark, d), dense, USER).select(USER, COHORT, "care_where")


def anti_cohort(spark: SparkSession, d: str) -> DataFrame:
    people = tv.participants(spark, d)
    dense = cohorts.with_prefix(_members(people), "Dense")
    return cohorts.exclude(people, dense, USER).select(USER, COHORT)


def user_set_algebra(spark: SparkSession, d: str) -> DataFrame:
    people = tv.participants(spark, d)
    dense = people.filter(cohorts.any_valid(VALID)).select(USER)
    alpha = people.filter(F.col(COHORT) == "alpha").select(USER)
    sets = {
        "both": cohorts.intersect_users(dense, alpha),
        "either": cohorts.union_users(dense, alpha),
        "dense only": cohorts.subtract_users(dense, alpha),
    }
    return reshape.all_rows(*[s.withColumn("part", F.lit(name)) for name, s in sets.items()])


def distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return tv.activity_panel(spark, d).select(USER, COHORT).distinct()


# --- summary tables --------------------------------------------------------------------------------------


def _demographics(spark: SparkSession, d: str, labelled: Column) -> DataFrame:
    return study.answer_counts(tv.participants(spark, d), labelled, QUESTIONS, study.tidy_answer())


def summary_percent(spark: SparkSession, d: str) -> DataFrame:
    return summary.summary_table(_demographics(spark, d, _labels()), ALL + DENSE, "percent")


def summary_ordered(spark: SparkSession, d: str) -> DataFrame:
    labels = {"4-Not Specified": "Not Specified"}
    counted = study.answer_counts(tv.participants(spark, d), _full(), QUESTIONS, study.tidy_answer(labels))
    answers = [
        "Africa", "America", "Asia", "Europe", "Middle East", "Building", "Furniture", "Household", "1-Urgent",
        "2-High", "3-Medium", "5-Low", "Not Specified", "Unavailable",
    ]
    return study.ordered_summary(
        summary.summary_table(counted, ALL, "percent"), ["priority", "area", "segment"], answers
    )


def summary_count(spark: SparkSession, d: str) -> DataFrame:
    people = summary.collapse_flags(tv.participants(spark, d), CONDITIONS[:3], "cond_any")
    names = {"Cond Any": "Any Condition"}
    return study.condition_table(people, _full(), CONDITIONS, ALL, names)


def care_summary(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda a: recode(F.coalesce(a, F.lit("unavailable")), PLACE_NAMES)
    counted = study.answer_counts(_labelled(_care(spark, d), tv.participants(spark, d)), _full_of(), CARE, clean)
    order = reshape.last_wins(PLACE_NAMES.values(), ["Yes", "No", "Unavailable"])
    return study.ordered_summary(summary.summary_table(counted, ALL, "percent"), CARE, order)


def summary_continuous(spark: SparkSession, d: str) -> DataFrame:
    return summary.continuous_summary(tv.participants(spark, d), [COHORT], "balance")


def summary_continuous_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """Two continuous questions in six overlapping cohorts."""
    largest = tv.table(spark, d, "orders").groupBy(F.col("o_custkey").alias(USER)).agg(
        F.max("o_totalprice").alias("largest_order")
    )
    people = tv.participants(spark, d).join(largest, USER, "left")
    rows = cut(people.select(_labels().alias("labels"), "balance", "largest_order"))  # read in every round
    long = reshape.melt(
        rows.select(F.explode("labels").alias("cohort_label"), "balance", "largest_order"), ["cohort_label"],
        ["balance", "largest_order"],
    )
    return summary.continuous_table(long, ALL + DENSE)


def summary_headers(spark: SparkSession, d: str) -> DataFrame:
    """The percent table with the size of each cohort in its column's name."""
    people = tv.participants(spark, d)
    table = summary.summary_table(_demographics(spark, d, _full()), ALL, "percent")
    return summary.with_sizes(table, _sizes(people), ALL)


def answers_complete(spark: SparkSession, d: str) -> DataFrame:
    """Counts that were checked against their rows while they were made."""
    long = reshape.melt(
        tv.participants(spark, d).select(F.explode(_labels()).alias("cohort_label"), *QUESTIONS), ["cohort_label"], QUESTIONS
    )
    counted = summary.complete_counts(long, ["cohort_label", "variable"], clean=study.tidy_answer())
    return counted.groupBy("cohort_label", "variable").agg(
        F.sum("n").alias("n_answers"), F.count(F.lit(1)).alias("n_distinct")
    )


def activity_set_sizes(spark: SparkSession, d: str) -> DataFrame:
    people = tv.participants(spark, d)
    return cohorts.sizes(cohorts.membership(people, USER, cohorts.activity_label(VALID, *ACTIVITY)), USER)


def contingency(spark: SparkSession, d: str) -> DataFrame:
    return summary.contingency(_demographics(spark, d, _full()), ALL)


def flag_crosstab(spark: SparkSession, d: str) -> DataFrame:
    return summary.flag_crosstab(tv.participants(spark, d), USER, CONDITIONS[:3])


def collapse_flags(spark: SparkSession, d: str) -> DataFrame:
    return summary.collapse_flags(tv.participants(spark, d), CONDITIONS[:3], "cond_any").select(
        USER, *CONDITIONS
    )


def item_order(spark: SparkSession, d: str) -> DataFrame:
    people = tv.participants(spark, d).filter(F.col(COHORT) == "alpha")
    flags = CONDITIONS[:3]
    sums = people.agg(*[F.count_if(F.col(c)).alias(c) for c in flags]).unpivot([], flags, "variable", "n")
    return study.place_in_order(sums, F.desc("n"), F.asc("variable"))


# --- tests on tables -------------------------------------------------------------------------------------


def _tested(df: DataFrame) -> DataFrame:
    return _rounded(df, "chi2", "p_value", "threshold")


def _z_tested(df: DataFrame) -> DataFrame:
    return _rounded(df, "p1", "p2", "p_all", "z", "p_value")


def chi_square(spark: SparkSession, d: str) -> DataFrame:
    return _tested(inference.chi_square(_demographics(spark, d, _full())))


def chi_square_dense(spark: SparkSession, d: str) -> DataFrame:
    return _tested(inference.chi_square(_demographics(spark, d, cohorts.activity_label(VALID))))


def chi_square_care(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda a: F.coalesce(a, F.lit("unavailable"))
    return _tested(inference.chi_square(study.answer_counts(_labelled(_care(spark, d), tv.participants(spark, d)), _full_of(), CARE, clean)))


def _symptom_counts(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda a: F.coalesce(a, F.lit(""))
    return study.answer_counts(_labelled(tv.events_survey(spark, d), tv.participants(spark, d)), _full_of(), SYMPTOMS, clean)


def chi_square_symptoms(spark: SparkSession, d: str) -> DataFrame:
    return _tested(inference.chi_square(study.pooled_presence(_symptom_counts(spark, d))))


def _sizes(people: DataFrame) -> DataFrame:
    return cohorts.sizes(_members(people), USER)


def two_prop_z(spark: SparkSession, d: str) -> DataFrame:
    people = tv.participants(spark, d)
    rows = people.withColumn("labels", _labels())
    return _z_tested(
        inference.two_proportions(rows, "labels", PAIRS, _sizes(people), QUESTIONS, clean=study.tidy_answer())
    )


def two_prop_z_dense(spark: SparkSession, d: str) -> DataFrame:
    people = tv.participants(spark, d).withColumn("labels", cohorts.activity_label(VALID))
    sizes = cohorts.sizes(cohorts.membership(people, USER, F.col("labels")), USER)
    return _z_tested(
        inference.two_proportions(people, "labels", [ACTIVITY], sizes, QUESTIONS, clean=study.tidy_answer())
    )


def two_prop_z_care(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda a: F.coalesce(a, F.lit("unavailable"))
    people = tv.participants(spark, d)
    rows = _labelled(_care(spark, d), people)
    return _z_tested(inference.two_proportions(rows, "labels", PAIRS, _sizes(people), CARE, clean=clean))


def two_prop_z_symptoms(spark: SparkSession, d: str) -> DataFrame:
    clean = lambda a: F.coalesce(a, F.lit(""))
    people = tv.participants(spark, d)
    rows = _labelled(tv.events_survey(spark, d), people)
    return _z_tested(inference.two_proportions(rows, "labels", PAIRS, _sizes(people), SYMPTOMS, clean=clean))


# --- symptoms --------------------------------------------------------------------------------------------


def _combos(spark: SparkSession, d: str) -> DataFrame:
    rows = tv.events_survey(spark, d).filter(F.col(COHORT).isin("alpha", "beta"))
    return study.combination_counts(rows, COHORT, SYMPTOMS)


def symptom_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = study.presence(tv.events_survey(spark, d), [COHORT], SYMPTOMS)
    return rows.groupBy(COHORT).agg(
        F.count(F.lit(1)).alias("n_rows"), *[total(F.col(s).cast("long")).alias(s) for s in SYMPTOMS]
    )


def top_symptoms(spark: SparkSession, d: str) -> DataFrame:
    shares = study.top_symptom_shares(_combos(spark, d), COHORT, ("alpha", "beta"), 3)
    return _rounded(shares, "share", "alpha_percent", "beta_percent")


def symptom_sets(spark: SparkSession, d: str) -> DataFrame:
    return study.symptom_sets(_combos(spark, d), COHORT, ["alpha", "beta"], 3)


def symptom_set_count(spark: SparkSession, d: str) -> DataFrame:
    return study.symptom_set_count(_combos(spark, d), COHORT, ["alpha", "beta"], 3)


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    reports = timecourse.daily_reports(tv.daily_symptoms(spark, d), [COHORT], DAY, ITEMS)
    totals = timecourse.daily_totals(reports, [COHORT], DAY, ITEMS)
    return timecourse.peak_days(totals, [COHORT], DAY, before=2, after=2)


def peak_day(spark: SparkSession, d: str) -> DataFrame:
    return _peaks(spark, d)


def peak_day_trailing(spark: SparkSession, d: str) -> DataFrame:
    alpha = tv.daily_symptoms(spark, d).filter(F.col(COHORT) == "alpha")
    return study.order_by_peak(timecourse.daily_reports(alpha, [COHORT], DAY, ITEMS), COHORT, DAY, ITEMS, "alpha")


def symptom_summary(spark: SparkSession, d: str) -> DataFrame:
    matched = dict(zip(ITEMS, tv.SYMPTOMS))  # the test tables name daily items and event symptoms differently
    peaks = _peaks(spark, d).withColumn("variable", recode(F.col("variable"), matched))
    return study.symptom_summary(_symptom_counts(spark, d), peaks, dict(zip(ALL, tv.COHORTS)), COHORT)


def prevalence_by_day(spark: SparkSession, d: str) -> DataFrame:
    wide = study.prevalence_panels(tv.daily_symptoms(spark, d), COHORT, DAY, ITEMS, tv.COHORTS, "alpha")
    return _rounded(wide, *tv.COHORTS)


# --- durations -------------------------------------------------------------------------------------------


def _durations(spark: SparkSession, d: str) -> DataFrame:
    return study.durations(tv.events_survey(spark, d), "date_onset", "date_recovery")


def duration_median(spark: SparkSession, d: str) -> DataFrame:
    # whole days take few distinct values, so the built-in exact median keeps a short buffer
    return _durations(spark, d).groupBy(COHORT).agg(
        F.count("duration").alias("n"), F.median("duration").alias("median")
    )


def duration_density(spark: SparkSession, d: str) -> DataFrame:
    curve = inference.kernel_density(_durations(spark, d), COHORT, "duration")
    return curve.select(COHORT, "point", _r("x"), _r("density", places=8))


def rank_sum_pairs(spark: SparkSession, d: str) -> DataFrame:
    tested = study.duration_tests(_durations(spark, d), COHORT, tv.COHORTS)
    return _rounded(tested, "u", "z", "p_value")


def rank_sum_exact(spark: SparkSession, d: str) -> DataFrame:
    """Few members a side: the nations of two regions by their customers' balances, in cents."""
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    nations = tv.table(spark, d, "nation").join(tv.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    held = tv.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum(cents).alias("cents"))
    regions = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    tested = inference.rank_sum_pairs(nations.join(held, "n_nationkey"), "r_name", "cents", regions, small=8)
    return _rounded(tested, "z", "p_value")


def density_continuous(spark: SparkSession, d: str) -> DataFrame:
    curve = inference.binned_density(tv.participants(spark, d), COHORT, "balance")
    return curve.select(COHORT, "point", _r("x"), _r("density", places=10))


# --- panels ----------------------------------------------------------------------------------------------


def valid_user_counts(spark: SparkSession, d: str) -> DataFrame:
    return panel.valid_user_counts(tv.activity_panel(spark, d), USER, COHORT, CHANNELS)


def zscore_user(spark: SparkSession, d: str) -> DataFrame:
    columns = [f"{c}__observed" for c in CHANNELS]
    rows = cut(tv.activity_panel(spark, d).select(USER, "study_date", *columns))  # read for statistics and scores
    scored = panel.zscores(rows, USER, columns)
    return scored.select(USER, "study_date", *[_r(f"{c}_z") for c in columns])


def user_rank(spark: SparkSession, d: str) -> DataFrame:
    return panel.user_ranks(tv.activity_panel(spark, d), USER, COHORT, "date_onset", CHANNELS, OFFSETS)


def coverage_grid(spark: SparkSession, d: str) -> DataFrame:
    names = {"heart": "RHR", "steps": "Steps", "sleep": "Sleep"}
    flags = [*VALID, *[f"valid_day__{c}" for c in CHANNELS]]
    rows = cut(tv.activity_panel(spark, d).select(USER, COHORT, "study_date", "date_onset", DAY, *flags))
    return panel.coverage_grid(
        rows, USER, COHORT, "study_date", "date_onset", DAY, CHANNELS, OFFSETS, names
    )


def coverage_order(spark: SparkSession, d: str) -> DataFrame:
    grid = coverage_grid(spark, d).groupBy(COHORT, "channel", "day_type").agg(F.count(F.lit(1)).alias("n_days"))
    return study.in_coverage_order(grid, COHORT, ["alpha", "gamma", "beta"], ["Steps", "RHR", "Sleep"])


def elevated_rate(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: all thresholds in one pass over the z-scores of the observed values."""
    valid = tv.activity_panel(spark, d).filter(F.col("valid_user__heart") == 1)
    rows = cut(valid.select(USER, COHORT, DAY, "heart__observed"))  # statistics, scores and users read it
    scored = panel.zscores(rows, USER, ["heart__observed"])
    curve = timecourse.elevated_rate(scored, COHORT, DAY, USER, "heart__observed_z", THRESHOLDS)
    return _rounded(curve, "share", "error_bar", "expected")


# --- models ----------------------------------------------------------------------------------------------


def _specs() -> list[mixed.MixedSpec]:
    return study.channel_models(STATES, F.col("flu_period") == "baseline")


def _fits(spark: SparkSession, d: str) -> tuple[DataFrame, mixed.MixedFits]:
    # the models pass over the panel several times, each time over a few columns
    days = cut(tv.activity_panel(spark, d), USER)
    return days, mixed.fit_mixed(days, USER, _specs())


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    days, fits = _fits(spark, d)
    return study.model_outputs(days, fits, CHANNELS)


def lmm_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels, reference level first, of two factors: the model's own, and cohort and period together."""
    days = tv.activity_panel(spark, d).withColumn("setting", F.concat_ws(" in ", COHORT, "flu_period"))
    specs = [
        spec
        for factor, end in (("day_of_week", ""), ("setting", " by setting"))
        for spec in (dataclasses.replace(s, name=s.name + end, factor=factor) for s in _specs())
    ]
    return mixed.model_levels(days, USER, specs)


def _summed(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixed.MixedSpec], DataFrame]:
    days = cut(tv.activity_panel(spark, d), USER)
    specs = mixed.with_levels(days, USER, _specs())
    return days, specs, mixed.user_moments(mixed.model_rows(days, USER, specs), USER, specs)


def lmm_user_sums(spark: SparkSession, d: str) -> DataFrame:
    sums = _summed(spark, d)[2]
    return _rounded(sums, *[f"s_{j}" for j in range(4)], "s_y", places=4)


def _centred(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixed.MixedSpec], DataFrame, dict[str, list[float]]]:
    days, specs, sums = _summed(spark, d)
    sums = cut(sums)
    return days, specs, sums, mixed.column_means(mixed.column_totals(sums, 4), 4)


def _binary(column: str, name: str | None = None) -> Column:
    """Rounded to 2**-13. Means and products of two-decimal values often end in a decimal half, never in half of that."""
    return (F.round(F.col(column) * 8192) / 8192).alias(name or column)


def lmm_level_products(spark: SparkSession, d: str) -> DataFrame:
    days, specs, _, means = _centred(spark, d)
    products = mixed.level_products(mixed.model_rows(days, USER, specs, means), 4)
    return products.select(*products.columns[:3], *[_binary(c) for c in products.columns[3:]])


def lmm_size_products(spark: SparkSession, d: str) -> DataFrame:
    _, specs, sums, means = _centred(spark, d)
    products = mixed.size_products(sums, means, 4, mixed.dummies(specs))
    return products.select(*products.columns[:3], *[_binary(c) for c in products.columns[3:]])


def lmm_fit(spark: SparkSession, d: str) -> DataFrame:
    _, fits = _fits(spark, d)
    table = fits.coefficients().join(fits.variances(), "model")
    return _rounded(
        table, "estimate", "std_error", "t_value", "residual_variance", "user_variance", "criterion", places=4
    )


def lmm_predict(spark: SparkSession, d: str) -> DataFrame:
    days, fits = _fits(spark, d)
    names = [f"{s.name}__predicted" for s in fits.specs]
    return fits.predict(days).select(USER, "study_date", *[_binary(n) for n in names])


def impute_values(spark: SparkSession, d: str) -> DataFrame:
    outputs = _outputs(spark, d)
    return outputs.select(
        USER, "study_date", *[_binary(f"{c}__imputed") for c in CHANNELS],
        *[f"{c}__was_imputed" for c in CHANNELS],
    )


def residuals(spark: SparkSession, d: str) -> DataFrame:
    names = [f"{c}{kind}" for c in CHANNELS for kind in ("__resids", "__bl_resids")]
    return _outputs(spark, d).select(USER, "study_date", *[_binary(n) for n in names])


def zscore_imputed(spark: SparkSession, d: str) -> DataFrame:
    scored = study.scored_outputs(cut(_outputs(spark, d)), USER, CHANNELS)  # read for the statistics and the scores
    return scored.select(USER, "study_date", *[_r(f"{c}__imputed_z", places=4) for c in CHANNELS])


def elevated_rate_imputed(spark: SparkSession, d: str) -> DataFrame:
    outputs = _outputs(spark, d).filter(F.col("valid_user__heart") == 1)
    scored = panel.zscores(cut(outputs.select(USER, COHORT, DAY, "heart__imputed")), USER, ["heart__imputed"])
    curve = timecourse.elevated_rate(scored, COHORT, DAY, USER, "heart__imputed_z", THRESHOLDS)
    return _rounded(curve, "share", "error_bar", "expected")


def excess_by_day(spark: SparkSession, d: str) -> DataFrame:
    long = study.excess_long(_outputs(spark, d), ["steps", "sleep"], [USER, COHORT], DAY)
    return _rounded(study.excess_by_day(long, COHORT, DAY), "mean_excess", places=4)


def smooth_curve(spark: SparkSession, d: str) -> DataFrame:
    long = study.excess_long(_outputs(spark, d), ["steps", "sleep"], [USER, COHORT], DAY)
    return _rounded(study.excess_curves(long, USER, COHORT, DAY), "mean_y", "fit", "se", "low", "high", places=4)


def smooth_fit(spark: SparkSession, d: str) -> DataFrame:
    """What a summary of the smooth fits says: variances and effective degrees of freedom."""
    long = study.excess_long(_outputs(spark, d), ["steps", "sleep"], [USER, COHORT], DAY)
    table = study.excess_fits(long, USER, COHORT, DAY).summary()
    return _rounded(
        table, "residual_variance", "user_variance", "smooth_variance", "edf_curve", "edf_users", places=4
    )


def _by_state(spark: SparkSession, d: str) -> DataFrame:
    """Model outputs with the day's state mean in place of a fitted prediction: the same rules, checkable in SQL."""
    scale = {"steps": 1000.0, "heart": 1.0, "sleep": 60.0}
    means = {f"{c}{kind}__predicted": F.col(STATES[c]) * scale[c] for c in CHANNELS for kind in ("", "_bl")}
    filled = mixed.impute(tv.activity_panel(spark, d).withColumns(means), CHANNELS)
    return mixed.residuals(filled, {f"{c}__bl_resids": (f"{c}__observed", f"{c}_bl__predicted") for c in CHANNELS})


def impute_by_state(spark: SparkSession, d: str) -> DataFrame:
    columns = [f"{c}__imputed" for c in CHANNELS]
    flags = [f"{c}__was_imputed" for c in CHANNELS]
    rows = cut(_by_state(spark, d).select(USER, "study_date", *columns, *flags))
    scored = panel.zscores(rows, USER, columns)
    return _rounded(scored, *columns, *[f"{c}_z" for c in columns], places=5)


def excess_by_state(spark: SparkSession, d: str) -> DataFrame:
    long = study.excess_long(_by_state(spark, d), ["steps", "sleep"], [USER, COHORT], DAY)
    return _rounded(study.excess_by_day(long, COHORT, DAY), "mean_excess", places=5)


def spread_medians(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ranking.spread_median(tv.participants(spark, d), [COHORT], "balance"), "median", places=4)


def error_bars(spark: SparkSession, d: str) -> DataFrame:
    shares = tv.activity_panel(spark, d).groupBy(COHORT, DAY).agg(
        F.count(F.lit(1)).alias("n"), ratio(F.sum("valid_day__heart"), F.count(F.lit(1))).alias("share")
    )
    variance = inference.proportion_variance(F.col("share"), F.col("n"))
    return shares.select(COHORT, DAY, "n", _r("share"), _r(variance, "variance", 8))


QUERIES = {
    f.__name__: f
    for f in [
        scan_csv, scan_csv_by_name, preview, select_cols, select_pattern, derived_names,
        rename_map, recode_labels, filter_eq, filter_in, null_flags,
        filter_range, filter_compare, filter_any_flag, fill_nulls, dense_users, care_location_clean,
        panel_consistency, melt_long, split_name, pivot_cohort, cohort_sizes, semi_cohort, anti_cohort,
        user_set_algebra, distinct_users, summary_percent, summary_ordered, summary_count, care_summary,
        summary_continuous, summary_continuous_cohorts, summary_headers, answers_complete, activity_set_sizes, contingency, flag_crosstab, collapse_flags, item_order, chi_square, chi_square_dense,
        chi_square_care, chi_square_symptoms, two_prop_z, two_prop_z_dense, two_prop_z_care, two_prop_z_symptoms,
        symptom_totals, top_symptoms, symptom_sets, symptom_set_count, peak_day, peak_day_trailing, symptom_summary, prevalence_by_day,
        duration_median, duration_density, density_continuous, rank_sum_pairs, rank_sum_exact, valid_user_counts,
        zscore_user, user_rank, coverage_grid, coverage_order,
        elevated_rate, error_bars, spread_medians, lmm_levels, lmm_user_sums, lmm_level_products,
        lmm_size_products, lmm_fit, lmm_predict, impute_values, residuals,
        zscore_imputed, elevated_rate_imputed, excess_by_day, smooth_curve, smooth_fit, impute_by_state, excess_by_state,
    ]
}
