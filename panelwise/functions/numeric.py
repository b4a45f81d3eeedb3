"""Null-safe arithmetic: the study rules for missing values, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Division that gives null, not an error, for a zero divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def total(value: Column) -> Column:
    """Sum in which an all-missing group gives zero."""
    return F.coalesce(F.sum(value), F.lit(0))


def row_total(columns: Iterable[Column]) -> Column:
    """Sum across columns, missing counted as zero."""
    columns = [F.coalesce(c, F.lit(0)) for c in columns]
    result = columns[0]
    for column in columns[1:]:
        result = result + column
    return result


def any_true(columns: Iterable[Column]) -> Column:
    """True when one of the columns is true; missing counts as false."""
    columns = [F.coalesce(c, F.lit(False)) for c in columns]
    result = columns[0]
    for column in columns[1:]:
        result = result | column
    return result


def above(value: Column, threshold: float) -> Column:
    """``value > threshold`` where a missing or NaN value counts as not above."""
    return F.coalesce((value > F.lit(float(threshold))) & ~F.isnan(value), F.lit(False))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
