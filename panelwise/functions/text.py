"""Text helpers over built-in functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters and lower-case the rest.

    ``initcap`` starts words after white space only, so it misses ``trade/technical`` and ``4-not``.
    """
    runs = F.split(text, r"(?<![\p{L}])(?=[\p{L}])")
    raised = F.transform(
        runs, lambda run: F.concat(F.upper(run.substr(1, 1)), F.lower(run.substr(F.lit(2), F.length(run))))
    )
    return F.array_join(raised, "")


def last_part(text: Column, separator: str = "__") -> Column:
    """The piece after the last separator, or the whole text when there is none."""
    return F.split_part(text, F.lit(separator), F.lit(-1))


def recode(value: Column, labels: Mapping[str, str]) -> Column:
    """Replace the keys of ``labels`` by their values; other values stay."""
    if not labels:
        return value
    pairs = [F.lit(part) for pair in labels.items() for part in pair]
    return F.coalesce(F.create_map(*pairs)[value], value)


def percent_text(percent: Column) -> Column:
    """``12.5%``: one decimal, ties to even."""
    return F.concat(F.bround(percent, 1).cast("string"), F.lit("%"))


def count_percent_text(count: Column, percent: Column) -> Column:
    """``12 (12.5%)``."""
    return F.concat(count.cast("string"), F.lit(" ("), percent_text(percent), F.lit(")"))
