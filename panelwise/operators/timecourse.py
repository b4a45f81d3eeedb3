"""Curves over days relative to an event: totals, shares, rolling means and peaks.

Rows are first reduced to one per (cohort, day); windows only ever see those, and days bound them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.numeric import above, ratio, total
from panelwise.functions.tails import normal_upper
from panelwise.operators.inference import proportion_variance


def rolling_mean(value: Column, by: list[str], order: str, before: int, after: int = 0) -> Column:
    """Mean over a frame of rows; null until the frame is full, or when one of its values is missing."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-before, after)
    return F.when(F.count(value).over(frame) == before + after + 1, F.avg(value).over(frame))


def daily_reports(df: DataFrame, by: list[str], day: str, items: list[str]) -> DataFrame:
    """Rows and sum of every item per (by..., day), wide: the one pass over the participant-days."""
    return (
        df.dropna(subset=[*by, day])
        .groupBy(*by, day)
        .agg(F.count(F.lit(1)).alias("n_rows"), *[total(F.col(c)).cast("double").alias(c) for c in items])
    )


def daily_totals(reports: DataFrame, by: list[str], day: str, items: list[str]) -> DataFrame:
    """``daily_reports`` in long form ``(by..., day, variable, total)``."""
    return reports.unpivot([*by, day], items, "variable", "total")


def peak_days(
    totals: DataFrame, by: list[str], day: str, before: int, after: int, value: str = "total"
) -> DataFrame:
    """Day with the largest rolling mean per (by..., variable): the earliest on ties, null when it never rises."""
    keys = [*by, "variable"]
    rolled = totals.withColumn("_mean", rolling_mean(F.col(value), keys, day, before, after))
    place = F.when(F.col("_mean").isNotNull(), F.struct(F.col("_mean"), -F.col(day)))
    return (
        rolled.groupBy(*keys)
        .agg(F.max(place).alias("_top"), F.max_by(day, place).alias("_day"))
        .select(*keys, F.when(F.col("_top._mean") > 0, F.col("_day")).alias("peak_day"))
    )


def prevalence(reports: DataFrame, by: list[str], day: str, items: list[str]) -> DataFrame:
    """Percent of all rows per (by..., day) that report each item; missing reports count as none."""
    shares = [ratio(F.col(c) * 100, F.col("n_rows")).alias(c) for c in items]
    return reports.select(*by, day, *shares).unpivot([*by, day], items, "variable", "percent")


def elevated_rate(
    df: DataFrame, cohort: str, day: str, user: str, z: str, thresholds: list[float], window: int = 3,
    first_day: int = -10, last_day: int = 20,
) -> DataFrame:
    """Share of each cohort above each threshold per day, smoothed, with half a standard deviation as the bar.

    One pass counts all thresholds. The mean over ``window`` rows is taken before the day range is cut, missing
    scores count as not above, and the bar uses the cohort's number of users.
    """
    names = [f"t{i}" for i in range(len(thresholds))]
    known = df.dropna(subset=[cohort])
    wide = (
        known.dropna(subset=[day])
        .groupBy(cohort, day)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            *[F.count_if(above(F.col(z), t)).alias(k) for t, k in zip(thresholds, names)],
        )
    )
    smooth = wide.select(
        cohort, day,
        *[rolling_mean(ratio(F.col(k), F.col("_n")), [cohort], day, window - 1).alias(k) for k in names],
    ).filter(F.col(day).between(first_day, last_day))
    per_threshold = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"), F.col(k).alias("share"),
                normal_upper(F.lit(float(t))).alias("expected"),
            )
            for t, k in zip(thresholds, names)
        ]
    )
    people = known.groupBy(cohort).agg(F.countDistinct(user).alias("n_users"))
    curve = smooth.select(cohort, day, F.inline(per_threshold)).join(people, cohort)
    bar = F.sqrt(proportion_variance(F.col("share"), F.col("n_users"))) / 2
    return curve.select(cohort, day, "threshold", "n_users", "share", bar.alias("error_bar"), "expected")
