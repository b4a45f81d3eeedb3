"""Prefix sums, ranks and medians over an order, without gathering a group in one task.

The rows are range-partitioned by (group, order), written once, and numbered inside each slice; the slices'
sums give every slice its starting value. One group, however large, spreads over many slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.numeric import total
from panelwise.session import cut


def running_totals(df: DataFrame, order: list[str], values: list[str], by: list[str] = ()) -> DataFrame:
    """Adds ``<value>_upto``, the sum over rows at or before this one in its group, and the group sum ``<value>_all``.

    ``order`` must be unique inside a group, and group keys must not be null. The result reads a cut, whose path it
    keeps as ``_cut_path``, so that it can be deleted once the result has been written.
    """
    by = list(by)
    # the slice numbers depend on sampled range borders, so they are written before they are used twice
    sliced = cut(df.repartitionByRange(*by, *order).withColumn("_slice", F.spark_partition_id()))
    keys = [*by, "_slice"]
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(*keys)
        .agg(*[total(F.col(v)).alias(f"_{v}") for v in values])
        .select(
            *keys,
            *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}_start") for v in values],
            *[F.sum(f"_{v}").over(Window.partitionBy(*by)).alias(f"{v}_all") for v in values],
        )
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(v).over(inside).alias(f"_{v}_local") for v in values])
    found = local.join(starts, keys).select(
        *df.columns, *[(F.col(f"_{v}_start") + F.col(f"_{v}_local")).alias(f"{v}_upto") for v in values],
        *[f"{v}_all" for v in values],
    )
    found._cut_path = sliced._cut_path
    return found


def row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """A global ``row_number`` over ``order``; rows whose first order column is null get no number.

    End ``order`` with a unique column: it keeps rows that share all other values spread over the slices.
    """
    ranked = F.col(order[0]).isNotNull()
    upto = running_totals(df.withColumn("_one", F.when(ranked, 1).otherwise(0).cast("long")), order, ["_one"])
    return upto.withColumn(name, F.when(ranked, F.col("_one_upto"))).select(*df.columns, name)


def spread_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact interpolating median of a column with many distinct values, NaN and null left out.

    The built-in ``median`` keeps all distinct values of a group in one buffer; this form does not.
    """
    counted = (
        df.dropna(subset=[*by, value]).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    )
    upto = running_totals(counted, [value], ["_n"], by)
    low = F.floor((F.col("_n_all") + 1) / 2)
    high = F.floor(F.col("_n_all") / 2) + 1
    covers = lambda place: (F.col("_n_upto") >= place) & (F.col("_n_upto") - F.col("_n") < place)
    return (
        upto.filter(covers(low) | covers(high))
        .groupBy(*by)
        .agg(((F.min(value) + F.max(value)) / 2.0).alias("median"))
    )


def oriented_ranks(
    df: DataFrame, user: str, date: str, cohort: str, offsets: dict[str, int], name: str = "user_rank"
) -> DataFrame:
    """Users in blocks by cohort, inside a block from the latest date rank to the first.

    Cohorts with larger ``offsets`` come first, those that are not listed (offset 0) last. Only the order of the
    offsets counts, so blocks stay apart for any number of users. Users without a date get no rank.
    """
    first = row_numbers(df, [date, user], "_date_rank")
    block = F.lit(0)
    for label, offset in offsets.items():
        block = F.when(F.col(cohort) == label, F.lit(-offset)).otherwise(block)
    placed = first.withColumns({
        "_block": F.when(F.col("_date_rank").isNotNull(), block), "_back": -F.col("_date_rank"),
    })
    return row_numbers(placed, ["_block", "_back", user], name).drop("_block", "_back", "_date_rank")
