"""Response counts and cohort summary tables.

Counts are one grouped job for all cohorts and questions; shares come from the counts, so the second
shuffle carries at most one row per (cohort, question, response) and no window gathers a question in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from panelwise.functions.numeric import any_true, ratio
from panelwise.functions.text import count_percent_text, percent_text
from panelwise.operators.ranking import spread_median
from panelwise.operators.selection import medians
from panelwise.session import cut


def counts(
    long: DataFrame, by: list[str], response: str = "value", clean: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Rows per (by..., response); rows with a missing key or (cleaned) response are not counted.

    ``clean`` rewrites responses. It runs once per distinct response after a first count, not once per row.
    """
    return _all_counts(long, by, response, clean).filter(F.col(response).isNotNull())


def _all_counts(long: DataFrame, by: list[str], response: str, clean: Callable[[Column], Column] | None) -> DataFrame:
    counted = long.dropna(subset=by).groupBy(*by, response).agg(F.count(F.lit(1)).alias("n"))
    if clean is None:
        return counted
    return counted.withColumn(response, clean(F.col(response))).groupBy(*by, response).agg(F.sum("n").alias("n"))


class IncompleteAnswers(ValueError):
    """Counts that do not add up to the rows they were taken from."""


def complete_counts(
    long: DataFrame, by: list[str], response: str = "value", clean: Callable[[Column], Column] | None = None
) -> DataFrame:
    """``counts``, written, for tables in which every row must have a (cleaned) response.

    Rows and answers are added up while the counts are computed, so the check needs no pass of its own. If they
    differ the short table of counts names the groups, and the counts are not returned.
    """
    seen = Observation()
    answered = F.col(response).isNotNull()
    every = _all_counts(long, by, response, clean)
    watched = every.observe(
        seen, F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(answered, F.col("n"))), F.lit(0)).alias("n_counted"),
    )
    written = cut(watched)
    totals = seen.get
    if totals["n_rows"] != totals["n_counted"]:
        missing = written.filter(~answered).orderBy(F.desc("n"), *by).limit(5).collect()
        groups = "; ".join(", ".join(str(r[c]) for c in by) + f": {r['n']}" for r in missing)
        raise IncompleteAnswers(
            f"{totals['n_counted']} answers in {totals['n_rows']} rows; without an answer: {groups}"
        )
    return written


def with_share(counted: DataFrame, within: list[str]) -> DataFrame:
    """Adds the group size ``n_group`` and ``percent`` of it."""
    counted = cut(counted)  # short, and read for the totals and for the rows
    totals = counted.groupBy(*within).agg(F.sum("n").alias("n_group"))
    joined = counted.join(totals, within)
    return joined.withColumn("percent", ratio(F.col("n") * 100, F.col("n_group")))


def cell_text(measure: str, n: Column, percent: Column) -> Column:
    """Table cell: ``percent`` (12.5%), ``count`` (3 (12.5%)) or ``n`` (3)."""
    if measure == "percent":
        return percent_text(percent)
    if measure == "count":
        return count_percent_text(n, percent)
    if measure == "n":
        return n
    raise ValueError(f"unknown measure {measure!r}")


EMPTY_CELL = {"percent": "0.0%", "count": "0 (0.0%)", "n": 0}


def summary_table(
    counted: DataFrame, cohorts: list[str], measure: str = "percent", cohort: str = "cohort_label",
    question: str = "variable", response: str = "value", fill: bool = True,
) -> DataFrame:
    """One row per (question, response), one column per cohort, from ``counts``.

    Attach the cohorts to the wide table before melting, so that the join moves one row per user and not one
    per answer.
    """
    shares = with_share(counted, [cohort, question])
    here = [F.col(cohort) == c for c in cohorts]
    wide = shares.groupBy(question, response).agg(
        *[F.max(F.when(at, F.col("n"))).alias(f"_n{i}") for i, at in enumerate(here)],
        *[F.max(F.when(at, F.col("percent"))).alias(f"_p{i}") for i, at in enumerate(here)],
    )
    cells = [cell_text(measure, F.col(f"_n{i}"), F.col(f"_p{i}")) for i in range(len(cohorts))]
    if fill:
        cells = [F.coalesce(cell, F.lit(EMPTY_CELL[measure])) for cell in cells]
    return wide.select(question, response, *[cell.alias(c) for cell, c in zip(cells, cohorts)])


def with_sizes(table: DataFrame, sizes: DataFrame, cohorts: list[str], label: str = "cohort_label") -> DataFrame:
    """Renames cohort columns to ``label (N=size)``; collects one number per cohort."""
    n = {r[label]: r["n_users"] for r in sizes.filter(F.col(label).isin(cohorts)).collect()}
    return table.withColumnsRenamed({c: f"{c} (N={n.get(c, 0)})" for c in cohorts})


def incomplete_groups(long: DataFrame, by: list[str], response: str = "value") -> DataFrame:
    """Groups whose counted responses do not add up to their rows; empty when every row has a response."""
    return (
        long.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count(response).alias("n_counted"))
        .filter("n_rows <> n_counted")
    )


def contingency(
    counted: DataFrame, cohorts: list[str], cohort: str = "cohort_label", question: str = "variable",
    response: str = "value",
) -> DataFrame:
    """Question x response x cohort counts with zeros for empty cells."""
    cells = [F.coalesce(F.sum(F.when(F.col(cohort) == c, F.col("n"))), F.lit(0)).alias(c) for c in cohorts]
    return counted.groupBy(question, response).agg(*cells)


def continuous_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and spread, median and range of a continuous column as text, one row per group."""
    known = df.dropna(subset=[*by, value])
    x = F.col(value)
    moments = known.groupBy(*by).agg(
        F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_sd"), F.min(x).alias("_low"), F.max(x).alias("_high")
    )
    text = lambda c: F.round(c, 4).cast("string")
    return moments.join(spread_median(known, by, value), by).select(
        *by,
        F.format_string("%.1f ± %.1f", "_mean", "_sd").alias("mean_sd"),
        text(F.col("median")).alias("median"),
        F.concat(text(F.col("_low")), F.lit(" - "), text(F.col("_high"))).alias("min_max"),
    )


STATISTICS = ["Mean ± SD", "Median", "Min - Max"]


def continuous_table(
    long: DataFrame, cohorts: list[str], cohort: str = "cohort_label", question: str = "variable", value: str = "value"
) -> DataFrame:
    """Rows (question, statistic), one text column per cohort: the continuous form of ``summary_table``.

    ``long`` has a row for every cohort and question of a person; cohorts may overlap. Means, ranges and medians of all
    groups are taken together, the medians by histograms, so neither a large cohort nor many questions are gathered.
    Medians and ranges are shown in full. A cohort without a value stays empty.
    """
    by = [cohort, question]
    x = F.col(value).cast("double")
    known = long.filter(F.col(cohort).isin(cohorts) & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moments = known.groupBy(*by).agg(
        F.avg(x).alias("_mean"), F.stddev_samp(x).alias("_sd"), F.min(x).alias("_low"), F.max(x).alias("_high")
    )
    texts = [
        F.format_string("%.1f ± %.1f", "_mean", F.coalesce("_sd", F.lit(float("nan")))),
        F.col("median").cast("string"), F.concat(F.col("_low").cast("string"), F.lit(" - "), F.col("_high").cast("string")),
    ]
    cells = F.inline(
        F.array(*[F.struct(F.lit(name).alias("statistic"), t.alias("_cell")) for name, t in zip(STATISTICS, texts)])
    )
    shown = moments.join(medians(known, by, value), by).select(*by, cells)
    return shown.groupBy(question, "statistic").agg(
        *[F.max(F.when(F.col(cohort) == c, F.col("_cell"))).alias(c) for c in cohorts]
    )


def flag_crosstab(df: DataFrame, user: str, flags: list[str]) -> DataFrame:
    """Distinct users per combination of flags, missing as false."""
    filled = df.select(user, *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])
    return filled.groupBy(*flags).agg(F.countDistinct(user).alias("n_users"))


def collapse_flags(df: DataFrame, flags: list[str], name: str) -> DataFrame:
    return df.withColumn(name, any_true([F.col(f) for f in flags]))
