"""Participant-day panels: validity checks, per-person scores and the coverage grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.text import last_part, recode
from panelwise.operators.cohorts import any_valid
from panelwise.operators.ranking import oriented_ranks


def contradictions(channels: list[str]) -> dict[str, Column]:
    """Named rules that a clean panel never meets: flags that contradict the observed value."""
    rules: dict[str, Column] = {}
    for c in channels:
        seen = F.col(f"{c}__observed").isNotNull()
        rules[f"{c}: value of a non-valid user"] = (F.col(f"valid_user__{c}") == 0) & seen
        rules[f"{c}: value on a non-valid day"] = (F.col(f"valid_day__{c}") == 0) & seen
        rules[f"{c}: valid day without a value"] = (F.col(f"valid_day__{c}") == 1) & ~seen
    return rules


def contradicting_rows(df: DataFrame, channels: list[str]) -> DataFrame:
    """Rows that meet any rule; empty on a clean panel."""
    broken = F.lit(False)
    for rule in contradictions(channels).values():
        broken = broken | rule
    return df.filter(broken)


def contradiction_counts(df: DataFrame, channels: list[str]) -> DataFrame:
    """One row per rule with the number of rows that meet it: one pass, one result row per task."""
    rules = contradictions(channels)
    summed = df.agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return summed.unpivot([], list(rules), "rule", "n_rows")


def valid_user_counts(df: DataFrame, user: str, cohort: str, channels: list[str]) -> DataFrame:
    """Users with valid data per channel and cohort."""
    flags = [f"valid_user__{c}" for c in channels]
    users = df.select(user, cohort, *flags).distinct()
    wide = users.groupBy(cohort).agg(*[F.count_if(F.col(f) == 1).alias(f) for f in flags])
    long = wide.unpivot([cohort], flags, "variable", "n_users").filter("n_users > 0")
    return long.select(cohort, last_part(F.col("variable")).alias("channel"), "n_users")


def zscores(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Adds ``<column>_z``: distance from the person's mean in sample standard deviations.

    Statistics first, then a join: the statistics combine on the map side, and a person with very many rows is split by
    the adaptive skew join. That needs a shuffle right below both sides of the join, so the statistics are grouped under
    another key and dealt out once more for the join: one row a person.
    """
    stats = (
        df.groupBy(F.struct(by).alias("_person"))
        .agg(*[F.avg(c).alias(f"_{c}_mean") for c in columns], *[F.stddev_samp(c).alias(f"_{c}_sd") for c in columns])
        .withColumn(by, F.col("_person").getField(by)).drop("_person")
    )
    scored = df.join(stats, by, "left")
    z = [F.try_divide(F.col(c) - F.col(f"_{c}_mean"), F.col(f"_{c}_sd")).alias(f"{c}_z") for c in columns]
    return scored.select(*df.columns, *z)


def user_ranks(
    df: DataFrame, user: str, cohort: str, date: str, channels: list[str], offsets: dict[str, int]
) -> DataFrame:
    """Display rank of every user with a valid channel and a known cohort."""
    usable = any_valid([f"valid_user__{c}" for c in channels]) & F.col(cohort).isNotNull()
    users = df.filter(usable).select(user, cohort, date).distinct()
    return oriented_ranks(users, user, date, cohort, offsets).select(user, "user_rank")


def coverage_grid(
    df: DataFrame, user: str, cohort: str, date: str, onset: str, day: str, channels: list[str],
    offsets: dict[str, int], names: dict[str, str], onset_label: str = "Symptoms Onset",
    missing_label: str = "no observation",
) -> DataFrame:
    """User rank x date x channel with the kind of day, for the channels in which the user is valid.

    A user's validity is the same on all of the user's rows, so it is read from the row itself and the only
    join left is the one that brings the rank.
    """
    ranks = user_ranks(df, user, cohort, onset, channels, offsets)
    per_channel = F.array(
        *[
            F.struct(
                F.lit(c).alias("channel"), F.col(f"valid_user__{c}").alias("_user"),
                F.col(f"valid_day__{c}").alias("_day"),
            )
            for c in channels
        ]
    )
    kind = (
        F.when(F.col(day) == 0, onset_label)
        .when(F.col(day).isNull(), None)
        .when(F.col("_day") == 0, missing_label)
        .when(F.col("_day") == 1, F.concat(F.col(cohort), F.lit(" observation")))
    )
    shown = df.filter(any_valid([f"valid_user__{c}" for c in channels]) & F.col(cohort).isNotNull())
    # the rank is joined before a row becomes one row per channel
    ranked = shown.join(ranks, user, "left")
    long = ranked.select(user, cohort, date, day, "user_rank", F.inline(per_channel)).filter(F.col("_user") == 1)
    return long.select(
        user, cohort, date, "user_rank", recode(F.col("channel"), names).alias("channel"), kind.alias("day_type")
    )
