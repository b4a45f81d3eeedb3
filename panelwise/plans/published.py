"""All results of the published analysis on the four declared datasets (``sources/schemas.py``).

Each function takes the tables it needs and returns one result; the building blocks are in ``study``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.text import recode
from panelwise.operators import cohorts, inference, mixed, panel, reshape, summary, timecourse
from panelwise.plans import study
from panelwise.session import cut
from panelwise.sources import labels as text
from panelwise.sources.schemas import BOWEL_FLAGS, CHANNELS, CONDITIONS, DEMOGRAPHICS, SYMPTOMS

USER, COHORT, DAY, ONSET = "user_id", "cohort", "days_since_symptoms_onset", "date_onset_merged"
FLAGS = [f"valid_user__{c}" for c in CHANNELS]
FULL = [f"All {c}" for c in text.COHORTS]
DENSE = [f"Dense {c}" for c in text.COHORTS]
PAIRS = list(combinations(FULL, 2))
CARE = ["care_location__cleaned", "medical__hospitalized", "medical__medication"]
SYMPTOM_COLUMNS = [f"symptoms__{s}" for s in SYMPTOMS]
DAILY_COLUMNS = reshape.renamed(SYMPTOM_COLUMNS, "symptoms", "daily_symp")
ALL_CONDITIONS = [*CONDITIONS, "ibs_ibd_collapsed"]
STATES = {"steps": "state__steps__scale1k", "heart": "state__heart", "sleep": "state__sleep__scale60"}


def cohort_labels(prefix: str = "") -> Column:
    return F.filter(cohorts.labels(COHORT, FLAGS), lambda label: label.startswith(prefix))


def cohort_sizes(people: DataFrame) -> DataFrame:
    return cohorts.sizes(cohorts.membership(people, USER, cohort_labels()), USER)


def activity_sizes(people: DataFrame) -> DataFrame:
    return cohorts.sizes(cohorts.membership(people, USER, cohorts.activity_label(FLAGS)), USER)


# --- demographics ----------------------------------------------------------------------------------------


def demographics(people: DataFrame) -> DataFrame:
    """Percent of each full and dense cohort per answer, rows in published order, sizes in the column names."""
    counted = study.answer_counts(
        people, cohort_labels(), DEMOGRAPHICS, study.tidy_answer(text.EDUCATION_NAMES)
    )
    answers = [
        *text.AGE_ORDER, *text.BMI_ORDER, *text.EDUCATION_ORDER, *text.GENDER_ORDER, *text.RACE_ORDER, study.UNAVAILABLE
    ]
    table = study.ordered_summary(summary.summary_table(counted, FULL + DENSE), text.QUESTION_ORDER, answers)
    return summary.with_sizes(table, cohort_sizes(people), FULL + DENSE)


def demographic_tests(people: DataFrame, by_activity: bool = False) -> DataFrame:
    """Chi-square per question between the full cohorts, or between dense and other users."""
    labelled = cohorts.activity_label(FLAGS) if by_activity else cohort_labels("All")
    return inference.chi_square(study.answer_counts(people, labelled, DEMOGRAPHICS, study.tidy_answer()))


def demographic_pairs(people: DataFrame, questions: list[str], by_activity: bool = False) -> DataFrame:
    """Two-proportion tests per answer for all pairs of full cohorts, or dense against other users."""
    if by_activity:
        labelled, pairs, sizes = cohorts.activity_label(FLAGS), [("Dense Activity", "Non-dense Activity")], activity_sizes
    else:
        labelled, pairs, sizes = cohort_labels("All"), PAIRS, cohort_sizes
    rows = people.withColumn("labels", labelled)
    return inference.two_proportions(rows, "labels", pairs, sizes(people), questions, clean=study.tidy_answer())


# --- care ------------------------------------------------------------------------------------------------


def _care(events: DataFrame, people: DataFrame) -> DataFrame:
    place = study.care_location(F.col("medical__sought_attention_where"), list(text.CARE_NAMES))
    return study.with_labels(events.withColumn(CARE[0], place), people, USER, cohort_labels("All"))


def _answered(answer: Column) -> Column:
    return F.coalesce(answer, F.lit("unavailable"))


def care(events: DataFrame, people: DataFrame) -> DataFrame:
    names = text.CARE_ANSWER_NAMES | text.CARE_NAMES
    counted = study.answer_counts(
        _care(events, people), F.col("labels"), CARE, lambda answer: recode(_answered(answer), names)
    )
    order = reshape.last_wins(text.CARE_NAMES.values(), text.CARE_ANSWER_NAMES.values())
    table = study.ordered_summary(summary.summary_table(counted, FULL), CARE, order)
    named = table.withColumn("variable", recode(F.col("variable"), text.CARE_QUESTION_NAMES))
    return summary.with_sizes(named, cohort_sizes(people), FULL)


def care_tests(events: DataFrame, people: DataFrame) -> DataFrame:
    return inference.chi_square(study.answer_counts(_care(events, people), F.col("labels"), CARE, _answered))


def care_pairs(events: DataFrame, people: DataFrame) -> DataFrame:
    rows = _care(events, people)
    return inference.two_proportions(rows, "labels", PAIRS, cohort_sizes(people), CARE, clean=_answered)


# --- symptoms --------------------------------------------------------------------------------------------


def _blank(answer: Column) -> Column:
    return F.coalesce(answer, F.lit(""))


def _symptom_rows(events: DataFrame, people: DataFrame) -> DataFrame:
    return study.with_labels(events, people, USER, cohort_labels("All"))


def _symptom_counts(events: DataFrame, people: DataFrame) -> DataFrame:
    return study.answer_counts(_symptom_rows(events, people), F.col("labels"), SYMPTOM_COLUMNS, _blank)


def symptoms(events: DataFrame, people: DataFrame, days: DataFrame) -> DataFrame:
    """Percent with each symptom and its peak day (centred five-row mean) per cohort."""
    reports = timecourse.daily_reports(days, [COHORT], DAY, DAILY_COLUMNS)
    totals = timecourse.daily_totals(reports, [COHORT], DAY, DAILY_COLUMNS)
    peaks = timecourse.peak_days(totals, [COHORT], DAY, before=2, after=2)
    peaks = peaks.withColumn("variable", F.replace("variable", F.lit("daily_symp__"), F.lit("")))
    table = study.symptom_summary(_symptom_counts(events, people), peaks, dict(zip(FULL, text.COHORTS)), COHORT)
    named = table.withColumn("symptom", recode(F.col("symptom"), text.SYMPTOM_NAMES))
    return summary.with_sizes(named, cohort_sizes(people), FULL)


def symptom_test(events: DataFrame, people: DataFrame) -> DataFrame:
    """One pooled chi-square over reported symptoms x cohorts."""
    return inference.chi_square(study.pooled_presence(_symptom_counts(events, people)))


def symptom_pairs(events: DataFrame, people: DataFrame) -> DataFrame:
    rows = _symptom_rows(events, people)
    return inference.two_proportions(rows, "labels", PAIRS, cohort_sizes(people), SYMPTOM_COLUMNS, clean=_blank)


def co_occurrence(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frequent sets of top symptoms, and the totals of these symptoms, in the first two cohorts."""
    two = text.COHORTS[:2]
    combos = study.combination_counts(events.filter(F.col(COHORT).isin(two)), COHORT, SYMPTOM_COLUMNS)
    return study.symptom_sets(combos, COHORT, two), study.top_symptom_shares(combos, COHORT, tuple(two))


def conditions(people: DataFrame) -> DataFrame:
    """Users with each self-reported condition per cohort."""
    rows = summary.collapse_flags(people, BOWEL_FLAGS, "ibs_ibd_collapsed")
    table = study.condition_table(rows, cohort_labels("All"), ALL_CONDITIONS, FULL, text.CONDITION_NAMES)
    return summary.with_sizes(table, cohort_sizes(people), FULL)


def bowel_crosstab(people: DataFrame) -> DataFrame:
    return summary.flag_crosstab(people, USER, BOWEL_FLAGS)


# --- durations and daily prevalence ----------------------------------------------------------------------


def _durations(events: DataFrame) -> DataFrame:
    return study.durations(events, ONSET, "date_recovery_merged")


def duration_medians(events: DataFrame) -> DataFrame:
    return _durations(events).groupBy(COHORT).agg(F.median("duration").alias("median"))


def duration_density(events: DataFrame) -> DataFrame:
    return inference.kernel_density(_durations(events), COHORT, "duration")


def duration_tests(events: DataFrame) -> DataFrame:
    return inference.rank_sum_pairs(_durations(events), COHORT, "duration", text.COHORTS, small=8)


def daily_prevalence(days: DataFrame) -> DataFrame:
    return study.prevalence_panels(days, COHORT, DAY, DAILY_COLUMNS, text.COHORTS, text.COHORTS[0])


# --- activity --------------------------------------------------------------------------------------------


def fit_activity(days: DataFrame) -> mixed.MixedFits:
    """Six random-intercept models: three channels, all days and baseline days."""
    return mixed.fit_mixed(days, USER, study.channel_models(STATES, F.col("flu_period") == "baseline"))


def activity_outputs(days: DataFrame, fits: mixed.MixedFits | None = None) -> DataFrame:
    """Predictions, imputed values, residuals and per-person z-scores for every participant-day."""
    known = days.drop("heart__imputed_z")
    outputs = cut(study.model_outputs(known, fits or fit_activity(days), CHANNELS))  # read twice for the z-scores
    return study.scored_outputs(outputs, USER, CHANNELS)


def valid_users(days: DataFrame) -> DataFrame:
    return panel.valid_user_counts(days, USER, COHORT, CHANNELS)


def elevated_heart_rate(days: DataFrame, z: str = "heart__imputed_z") -> DataFrame:
    """Share of users above 0, 0.5 and 1 standard deviations per day around onset."""
    valid = days.filter(F.col("valid_user__heart") == 1)
    return timecourse.elevated_rate(valid, COHORT, DAY, USER, z, [0.0, 0.5, 1.0])


def excess_curves(outputs: DataFrame) -> DataFrame:
    """Smooth curves of the baseline residuals of steps and sleep with mean, band and readable channel."""
    long = study.excess_long(outputs, ["steps", "sleep"], [USER, COHORT], DAY)
    curves = study.excess_curves(long, USER, COHORT, DAY)
    return curves.withColumn("channel", recode(F.col("channel"), text.EXCESS_NAMES))


def sensor_coverage(days: DataFrame) -> DataFrame:
    return panel.coverage_grid(
        days, USER, COHORT, "study_date", ONSET, DAY, CHANNELS, text.RANK_OFFSETS, text.CHANNEL_NAMES
    )
