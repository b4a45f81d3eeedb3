"""Cohorts as sets of users that may overlap: a membership table ``(cohort_label, user)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.functions.numeric import row_total


def any_valid(flags: list[str]) -> Column:
    """True when at least one 0/1 flag is set."""
    return row_total([F.col(f) for f in flags]) > 0


def labels(cohort: str, flags: list[str], full: str = "All ", dense: str = "Dense ") -> Column:
    """The cohorts of one participant row: its full cohort and, when any flag is set, its dense cohort."""
    named = F.col(cohort).isNotNull()
    return F.array_compact(
        F.array(
            F.when(named, F.concat(F.lit(full), cohort)),
            F.when(named & any_valid(flags), F.concat(F.lit(dense), cohort)),
        )
    )


def activity_label(flags: list[str], yes: str = "Dense Activity", no: str = "Non-dense Activity") -> Column:
    """One of two complementary sets: users with any flag set, and the rest."""
    return F.array(F.when(any_valid(flags), yes).otherwise(no))


def membership(people: DataFrame, user: str, labelled: Column) -> DataFrame:
    """The sets as a table ``(cohort_label, user)``, from a table with one row per user. No shuffle."""
    return people.select(F.explode(labelled).alias("cohort_label"), user)


def sizes(members: DataFrame, user: str, label: str = "cohort_label") -> DataFrame:
    return members.groupBy(label).agg(F.countDistinct(user).alias("n_users"))


def with_prefix(members: DataFrame, prefix: str, label: str = "cohort_label") -> DataFrame:
    return members.filter(F.col(label).startswith(prefix))


def attach(df: DataFrame, members: DataFrame, user: str) -> DataFrame:
    """Rows of ``df`` once per cohort of their user; rows of users in no cohort are dropped."""
    return df.join(members, user)


def restrict(df: DataFrame, users: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``users`` (semi join: never multiplies rows)."""
    return df.join(users, key, "left_semi")


def exclude(df: DataFrame, users: DataFrame, key: str) -> DataFrame:
    return df.join(users, key, "left_anti")


def union_users(*sets: DataFrame) -> DataFrame:
    merged = sets[0]
    for other in sets[1:]:
        merged = merged.unionByName(other)
    return merged.distinct()


def intersect_users(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def subtract_users(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)
