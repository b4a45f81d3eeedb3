"""Exact medians of many groups at once, by repeated histograms: no sort, and no group in one task.

Every round counts the rows of each group's bracket in equal bins, with each bin's least and largest value, and keeps the
bin that holds the middle rows. Counts combine on the map side, so a round moves at most a row for each group, bin and task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.session import cut

BINS = 1024


def medians(rows: DataFrame, by: list[str], value: str, bins: int = BINS) -> DataFrame:
    """``(by..., n, median)``: the interpolating median of every group; null, NaN and infinite values are left out.

    All groups share the rounds, and overlapping groups are simply more keys. A round divides the range by ``bins``
    and draws it to values that occur, so well-spread values need three or four rounds for any number of rows.
    """
    x = F.col(value).cast("double")
    known = rows.dropna(subset=by).select(*by, x.alias("_x")).filter("_x IS NOT NULL AND NOT isnan(_x) AND abs(_x) < double('Infinity')")
    middle = {"low": F.floor((F.col("n") + 1) / 2), "high": F.floor(F.col("n") / 2) + 1}
    state = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("least"), F.max("_x").alias("largest"))
    equal = F.when(F.col("least") == F.col("largest"), F.col("least"))
    state = cut(state.select("*", F.lit(0).cast("long").alias("below"), equal.alias("a"), equal.alias("b")))
    finished = [state.filter("a IS NOT NULL")]
    while not (open_ := state.filter("a IS NULL")).isEmpty():
        # by halves where the width of a range is no number, as from -1e308 to 1e308
        width = F.col("largest") - F.col("least")
        half = (F.col("_x") / 2 - F.col("least") / 2) / (F.col("largest") / 2 - F.col("least") / 2)
        place = F.when(width < float("inf"), (F.col("_x") - F.col("least")) / width).otherwise(half)
        inside = known.join(open_, by).filter("_x BETWEEN least AND largest")
        counted = (
            inside.withColumn("_bin", F.least(F.floor(place * bins), F.lit(bins - 1).cast("long")))
            .groupBy(*by, "_bin")
            .agg(
                F.count(F.lit(1)).alias("_k"), F.min("_x").alias("_least"), F.max("_x").alias("_largest"),
                F.first("n").alias("n"), F.first("below").alias("below"),
            )
        )
        upto = F.sum("_k").over(Window.partitionBy(*by).orderBy("_bin")) + F.col("below")
        placed = counted.withColumn("_upto", upto)  # at most ``bins`` rows a group
        holds = {k: (F.col("_upto") >= at) & (F.col("_upto") - F.col("_k") < at) for k, at in middle.items()}
        found = (
            placed.filter(holds["low"] | holds["high"])
            .groupBy(*by)
            .agg(
                F.first("n").alias("n"), F.min("_least").alias("least"), F.max("_largest").alias("largest"),
                F.min(F.col("_upto") - F.col("_k")).alias("below"), F.count(F.lit(1)).alias("_bins"),
                # in two bins, the middle rows are the last of one and the first of the other
                F.min("_largest").alias("_last"), F.max("_least").alias("_first"),
            )
        )
        settled = (F.col("_bins") == 2) | (F.col("least") == F.col("largest"))
        state = cut(
            found.select(
                *by, "n", "least", "largest", "below",
                F.when(settled, F.col("_last")).alias("a"), F.when(settled, F.col("_first")).alias("b"),
            )
        )
        finished.append(state.filter("a IS NOT NULL"))
    done = finished[0]
    for more in finished[1:]:
        done = done.unionByName(more)
    return done.select(*by, "n", ((F.col("a") + F.col("b")) / 2.0).alias("median"))
