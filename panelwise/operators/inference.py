"""Tests on counts and ranks, and kernel densities: grouped Spark jobs whose last step is a short table."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.numeric import ratio, total
from panelwise.functions.tails import chi_square_upper, normal_two_sided
from panelwise.operators.ranking import running_totals
from panelwise.session import cut


def chi_square(
    counted: DataFrame, question: str = "variable", response: str = "value", cohort: str = "cohort_label",
    alpha: float = 0.05,
) -> DataFrame:
    """Pearson test of response x cohort per question, from counts in long form (column ``n``).

    Empty cells need no rows: each adds its expected count, and together they add N - sum e over the other cells.
    Both N - sum e and o - e are taken from whole numbers, so that nothing cancels at large counts. Answers or cohorts
    without any count are left out. With one degree of freedom |o-e| is the same in all four cells, so Yates' correction
    follows from any cell and the reciprocal totals.
    """
    counted = cut(counted).filter("n > 0")  # read four times below; the responses themselves are read once
    rows = counted.groupBy(question, response).agg(F.sum("n").alias("_row"))
    cols = counted.groupBy(question, cohort).agg(F.sum("n").alias("_col"))
    by_row = rows.groupBy(question).agg(
        F.sum("_row").alias("n_total"), F.count(F.lit(1)).alias("_rows"), F.sum(1.0 / F.col("_row")).alias("_inv_row")
    )
    by_col = cols.groupBy(question).agg(F.count(F.lit(1)).alias("_cols"), F.sum(1.0 / F.col("_col")).alias("_inv_col"))
    n, row, col, total = (F.col(c).cast("decimal(19,0)") for c in ("n", "_row", "_col", "n_total"))
    apart, expected = (n * total - row * col).cast("double"), (row * col).cast("double")
    size = F.col("n_total").cast("double")
    cells = (
        counted.join(rows, [question, response])
        .join(cols, [question, cohort])
        .join(by_row.select(question, "n_total"), question)
        .groupBy(question)
        .agg(
            F.sum(apart / expected * apart / size).alias("_fit"), F.sum(row * col).alias("_filled"),
            F.max(F.struct("n", "_row", "_col")).alias("_cell"),
        )
    )
    cell = F.col("_cell")
    gap = F.abs(cell["n"] - cell["_row"].cast("double") * cell["_col"] / size)
    yates = F.pow(F.greatest(gap - 0.5, F.lit(0.0)), 2) * size * F.col("_inv_row") * F.col("_inv_col")
    plain = F.col("_fit") + (total * total - F.col("_filled")).cast("double") / size
    tested = (
        cells.join(by_row, question)
        .join(by_col, question)
        .withColumn("dof", ((F.col("_rows") - 1) * (F.col("_cols") - 1)).cast("int"))
        .withColumn("chi2", F.when(F.col("dof") == 1, yates).when(F.col("dof") == 0, F.lit(0.0)).otherwise(plain))
    )
    p = chi_square_upper(F.col("chi2"), F.col("dof"))
    # one row per question is left, so counting the questions here costs nothing
    questions = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    threshold = F.lit(alpha) / questions
    return tested.select(
        question, "n_total", "dof", "chi2", p.alias("p_value"), threshold.alias("threshold"),
        (p < threshold).alias("significant"),
    )


def two_proportions(
    wide: DataFrame, labels: str, pairs: list[tuple[str, str]], sizes: DataFrame, questions: list[str],
    cohort: str = "cohort_label", clean: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """z-test of every answer's share between the two cohorts of each pair, all questions and pairs at once.

    ``wide`` has one row per user with an array column of the user's cohorts; ``sizes`` gives ``n_users`` per
    cohort. Conditional counts cover both cohorts and their union (a user in both counts once there). An answer
    that neither cohort gave stays, with shares 0 and no z.
    """
    named = sorted({c for pair in pairs for c in pair})
    flag = {c: f"_in{i}" for i, c in enumerate(named)}
    # one flag per cohort and user, before the melt repeats the row per question
    flagged = wide.select(
        *[F.coalesce(F.array_contains(labels, c), F.lit(False)).alias(flag[c]) for c in named], *questions
    )
    long = flagged.unpivot(list(flag.values()), questions, "variable", "value")
    aggs = []
    for i, (a, b) in enumerate(pairs):
        in_a, in_b = F.col(flag[a]), F.col(flag[b])
        aggs += [
            F.count_if(in_a).alias(f"_a{i}"), F.count_if(in_b).alias(f"_b{i}"), F.count_if(in_a | in_b).alias(f"_u{i}")
        ]
    counted = long.groupBy("variable", "value").agg(*aggs)
    if clean is not None:
        sums = [F.sum(c).alias(c) for c in counted.columns[2:]]
        counted = counted.withColumn("value", clean(F.col("value"))).groupBy("variable", "value").agg(*sums)
    counted = cut(counted.filter(F.col("value").isNotNull()))  # short, and read for the totals and for the rows
    per_pair = F.array(
        *[
            F.struct(
                F.lit(a).alias("cohort1"), F.lit(b).alias("cohort2"), F.col(f"_a{i}").alias("_a"),
                F.col(f"_b{i}").alias("_b"), F.col(f"_u{i}").alias("_u"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    cells = counted.select("variable", "value", F.inline(per_pair))
    keys = ["cohort1", "cohort2", "variable"]
    answered = cells.groupBy(*keys).agg(*[F.sum(c).alias(f"{c}_all") for c in ("_a", "_b", "_u")])
    shares = cells.join(answered, keys).select(
        *keys, "value",
        *[
            F.coalesce(ratio(F.col(c), F.col(f"{c}_all")), F.lit(0.0)).alias(p)
            for c, p in (("_a", "p1"), ("_b", "p2"), ("_u", "p_all"))
        ],
    )
    sized = shares.join(
        sizes.select(F.col(cohort).alias("cohort1"), F.col("n_users").alias("n1")), "cohort1", "left"
    ).join(sizes.select(F.col(cohort).alias("cohort2"), F.col("n_users").alias("n2")), "cohort2", "left")
    spread = F.col("p_all") * (1 - F.col("p_all")) * (1.0 / F.col("n1") + 1.0 / F.col("n2"))
    z = F.try_divide(F.col("p1") - F.col("p2"), F.sqrt(spread))
    return sized.select(
        *keys, "value", "p1", "p2", "p_all", z.alias("z"), normal_two_sided(z).alias("p_value")
    )


def exact_rank_sum_p(u: float, n_a: int, n_b: int) -> float:
    """Two-sided probability under the null of a U as far from its middle, for sizes without ties.

    The counts of U over all arrangements are the coefficients of a Gaussian binomial. It is built up size by size: for
    the i-th member of the smaller side, times ``1 - q^(n+i)``, then divided by ``1 - q^i``, a running sum in steps of i.
    """
    few, many = sorted((n_a, n_b))
    ways = np.zeros(few * many + 1)
    ways[0] = 1.0
    for i in range(1, few + 1):
        if many + i < len(ways):
            ways[many + i:] = ways[many + i:] - ways[: len(ways) - many - i]
        for start in range(i):
            ways[start::i] = np.cumsum(ways[start::i])
    far = max(u, few * many - u)
    return float(min(1.0, 2.0 * ways[int(np.ceil(far)):].sum() / ways.sum()))


def _exact(batches):
    for batch in batches:
        p = [
            exact_rank_sum_p(r["u"], r["n_a"], r["n_b"]) if r["_exact"] else r["p_value"] for r in batch.to_pylist()
        ]
        at = batch.schema.get_field_index("p_value")
        yield batch.set_column(at, "p_value", pa.array(p, pa.float64()))


def rank_sum_pairs(
    df: DataFrame, cohort: str, value: str, cohorts: list[str], small: int = 0, cells: int = 10_000_000
) -> DataFrame:
    """Two-sided Mann-Whitney test for every pair of cohorts (large-sample form with tie correction).

    With ``small``, a pair without ties whose smaller cohort has at most so many members gets its exact p-value, unless
    the product of the sizes is above ``cells``; the statistic is the same. 8 is the usual choice.

    The rows collapse to one per distinct value with a count per cohort. With running counts over the values,
    U, the tie terms and the sizes of all pairs are sums over those rows: no pairing of rows, no self-join.
    """
    n = [f"n{i}" for i in range(len(cohorts))]
    counted = (
        df.filter(F.col(value).isNotNull() & F.col(cohort).isin(cohorts))
        .groupBy(value)
        .agg(*[F.count_if(F.col(cohort) == c).cast("double").alias(k) for c, k in zip(cohorts, n)])
    )
    upto = running_totals(counted, [value], n)
    pairs = [(i, j) for i in range(len(cohorts)) for j in range(i + 1, len(cohorts))]
    aggs = [total(F.col(k)).alias(f"size{i}") for i, k in enumerate(n)]
    for i, j in pairs:
        both = F.col(n[i]) + F.col(n[j])
        below = F.col(f"{n[j]}_upto") - F.col(n[j]) / 2.0
        aggs += [
            total(F.col(n[i]) * below).alias(f"u_{i}_{j}"),
            total(both * both * both - both).alias(f"ties_{i}_{j}"),
        ]
    sums = upto.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(cohorts[i]).alias("cohort_a"), F.lit(cohorts[j]).alias("cohort_b"),
                F.col(f"size{i}").cast("long").alias("n_a"), F.col(f"size{j}").cast("long").alias("n_b"),
                F.col(f"u_{i}_{j}").alias("u"), F.col(f"ties_{i}_{j}").alias("_ties"),
            )
            for i, j in pairs
        ]
    )
    a, b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    all_n = a + b
    variance = a * b / 12.0 * (all_n + 1 - F.try_divide(F.col("_ties"), all_n * (all_n - 1)))
    distance = F.greatest(F.abs(F.col("u") - a * b / 2.0) - 0.5, F.lit(0.0))
    z = F.try_divide(distance, F.sqrt(variance))
    few = (F.least("n_a", "n_b") <= small) & (F.col("_ties") == 0) & (F.col("n_a") * F.col("n_b") <= cells)
    tested = (
        sums.select(F.inline(rows))
        .filter((F.col("n_a") > 0) & (F.col("n_b") > 0))
        .select("cohort_a", "cohort_b", "n_a", "n_b", "u", z.alias("z"), normal_two_sided(z).alias("p_value"), few.alias("_exact"))
    )
    if not small:
        return tested.drop("_exact")
    return tested.mapInArrow(_exact, tested.schema).drop("_exact")  # one row a pair


def kernel_density(df: DataFrame, cohort: str, value: str, points: int = 200, reach: float = 3.0) -> DataFrame:
    """Gaussian density per cohort on an even grid that reaches ``reach`` bandwidths past the data.

    Bandwidth: sample standard deviation times n^(-1/5). Equal values are counted first; each distinct value is
    then spread over the grid and summed on the map side, so the cost follows the distinct values.
    """
    known = df.filter(F.col(value).isNotNull() & F.col(cohort).isNotNull())
    x = F.col(value).cast("double")
    counted = cut(known.groupBy(cohort, x.alias("_x")).agg(F.count(F.lit(1)).alias("_k")))
    centre = counted.groupBy(cohort).agg(
        F.sum("_k").alias("_n"), (F.sum(F.expr("_k * _x")) / F.sum("_k")).alias("_mean"),
        F.min("_x").alias("_low"), F.max("_x").alias("_high"),
    )
    spread = counted.join(centre.select(cohort, "_mean"), cohort).groupBy(cohort).agg(
        F.sum(F.expr("_k * (_x - _mean) * (_x - _mean)")).alias("_squares")
    )
    width = F.sqrt(F.try_divide(F.col("_squares"), F.col("_n") - 1)) * F.pow(F.col("_n"), F.lit(-0.2))
    support = centre.join(spread, cohort).select(
        cohort, "_n", width.alias("_bw"), (F.col("_low") - reach * width).alias("_start"),
        ((F.col("_high") - F.col("_low") + 2 * reach * width) / (points - 1)).alias("_step"),
    ).filter(F.col("_bw") > 0)
    at = F.col("_start") + F.col("point") * F.col("_step")
    u = (at - F.col("_x")) / F.col("_bw")
    kernel = F.col("_k") * F.exp(-u * u / 2.0)
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    return (
        counted.join(support, cohort)
        .withColumn("point", grid)
        .groupBy(cohort, "point")
        .agg(F.sum(kernel).alias("_sum"), F.first(at).alias("x"), F.first(F.col("_n") * F.col("_bw")).alias("_scale"))
        .select(cohort, "point", "x", (F.col("_sum") / F.col("_scale") / math.sqrt(2 * math.pi)).alias("density"))
    )


def binned_density(
    df: DataFrame, cohort: str, value: str, points: int = 200, reach: float = 3.0, cells: int = 1024
) -> DataFrame:
    """``kernel_density`` of a column with very many distinct values, linear in the rows.

    Each row is shared by the two ends of its cell of an even grid over the cohort's range, in one aggregate; the kernel
    then meets at most ``cells`` weights a cohort. With cells of width d and bandwidth h the density differs
    by at most 0.05 * (d / h)**2 / h from the sum over all rows.
    """
    x = F.col(value).cast("double")
    known = df.filter(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) & F.col(cohort).isNotNull())
    known = known.select(cohort, x.alias("_x"))
    width = F.stddev_samp("_x") * F.pow(F.count(F.lit(1)), F.lit(-0.2))
    support = known.groupBy(cohort).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high"), width.alias("_bw")
    )
    support = cut(support.filter("_bw > 0").withColumn("_cell", (F.col("_high") - F.col("_low")) / (cells - 1)))
    place = (F.col("_x") - F.col("_low")) / F.col("_cell")
    at = F.least(F.floor(place), F.lit(cells - 2).cast("long"))
    shares = known.join(support, cohort).select(cohort, at.alias("_at"), (place - at).alias("_right")).groupBy(cohort, "_at").agg(
        F.count(F.lit(1)).alias("_k"), F.sum("_right").alias("_right")
    )
    ends = F.inline(
        F.array(
            F.struct(F.col("_at").alias("_end"), (F.col("_k") - F.col("_right")).alias("_w")),
            F.struct((F.col("_at") + 1).alias("_end"), F.col("_right").alias("_w")),
        )
    )
    weights = shares.select(cohort, ends).groupBy(cohort, "_end").agg(F.sum("_w").alias("_w"))
    start = F.col("_low") - reach * F.col("_bw")
    step = (F.col("_high") - F.col("_low") + 2 * reach * F.col("_bw")) / (points - 1)
    spread = weights.join(support, cohort).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    to = start + F.col("point") * step
    u = (to - F.col("_low") - F.col("_end") * F.col("_cell")) / F.col("_bw")
    return (
        spread.groupBy(cohort, "point")
        .agg(
            F.sum(F.col("_w") * F.exp(-u * u / 2.0)).alias("_sum"), F.first(to).alias("x"),
            F.first(F.col("_n") * F.col("_bw")).alias("_scale"),
        )
        .select(cohort, "point", "x", (F.col("_sum") / F.col("_scale") / math.sqrt(2 * math.pi)).alias("density"))
    )


def proportion_variance(share: Column, n: Column) -> Column:
    """Variance of a proportion."""
    return ratio(share * (1 - share), n)
