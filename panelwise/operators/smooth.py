"""Smooth population curves over relative days with a random intercept per user.

The spline has its knots on all days of a fixed range, so its basis is the same for every curve: a literal of the plan,
read by the day's number without a join. All (channel, cohort) curves share two Spark jobs: sums per day and products
of per-user sums. The driver sees a row for each curve and day, and one for each curve and number of rows of a user.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.operators.reml import Moments, SmoothFit, fit_smooth
from panelwise.session import cut

#: Curves and numbers of rows of a user, together, whose products the driver takes; more of them are an error.
MOST_PRODUCTS = 200_000


def thin_plate_basis(days: np.ndarray, size: int = 10) -> np.ndarray:
    """Penalised part of a thin plate regression spline at its distinct points, scaled to a unit penalty.

    The radial functions |x-c|^3/12 at the data points are cut to the ``size`` largest eigenvectors, made
    orthogonal to straight lines and rescaled so that the coefficients are independent with equal variance.
    """
    x = np.asarray(days, dtype=float)
    size = min(size, len(x))
    if size < 3:
        return np.zeros((len(x), 0))
    radial = np.abs(x[:, None] - x[None, :]) ** 3 / 12.0
    values, vectors = np.linalg.eigh(radial)
    top = np.argsort(-np.abs(values))[:size]
    values, vectors = values[top], vectors[:, top]
    lines = np.column_stack([np.ones_like(x), x])
    q, _ = np.linalg.qr(vectors.T @ lines, mode="complete")
    free = q[:, 2:]
    penalty = free.T @ (values[:, None] * free)
    weights, turn = np.linalg.eigh((penalty + penalty.T) / 2)
    keep = weights > 1e-10 * weights.max()
    return (vectors * values) @ free @ turn[:, keep] / np.sqrt(weights[keep])


def range_design(first_day: int, last_day: int, size: int = 10) -> np.ndarray:
    """A row (1, scaled day, penalised basis) for every day of the range."""
    days = np.arange(first_day, last_day + 1, dtype=float)
    line = (days - days.mean()) / max(1.0, days[-1] - days[0])
    return np.column_stack([np.ones_like(days), line, thin_plate_basis(days, size)])


@dataclass(frozen=True)
class Curve:
    """A curve's sums per day (``stats``), the design of the days in it, its level, and its fit where there are enough rows."""

    stats: list
    design: np.ndarray
    shift: float
    fixed: int
    moments: Moments
    fit: SmoothFit | None


@dataclass(frozen=True)
class CurveFits:
    by: list[str]
    day: str
    keys: str
    fits: dict[tuple, Curve]
    rows: DataFrame

    def curves(self) -> DataFrame:
        """Per (by..., day): mean of y, fitted population curve, its standard error and the band around it."""
        table = []
        for key, c in self.fits.items():
            if c.fit is None:
                table += [(*key, r["_day"], r["mean"], None, None, None, None) for r in c.stats]
                continue
            curve = c.design @ c.fit.coef + c.shift
            error = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", c.design, c.fit.covariance, c.design), 0.0))
            table += [
                (*key, r["_day"], r["mean"], float(x), float(e), float(x - e), float(x + e))
                for r, x, e in zip(c.stats, curve, error)
            ]
        schema = f"{self.keys}, `{self.day}` int, mean_y double, fit double, se double, low double, high double"
        return self.rows.sparkSession.createDataFrame(table, schema)

    def summary(self) -> DataFrame:
        """One row per curve: rows, users, variances, and the effective degrees of freedom of the curve and of the users.

        They are the traces of the influence matrix over the terms' coefficients; the curve's include its straight line.
        """
        table = []
        for key, c in self.fits.items():
            counts = (int(sum(r["n"] for r in c.stats)), int(c.moments.users.sum()))
            if c.fit is None:
                table.append((*key, *counts, *[None] * 5))
                continue
            fit, wiggly = c.fit, slice(c.fixed, c.design.shape[1])
            inverse = fit.covariance / fit.sigma2
            free = c.fixed - 1 + len(inverse[wiggly]) - float(np.trace(inverse[wiggly, wiggly])) / fit.smooth_ratio
            a, n, users = fit.user_ratio, c.moments.size, c.moments.users
            p = len(inverse)
            shrunk = users / (1 + n * a)
            spread = a / (1 + n * a) ** 2 * np.einsum("ij,nij->n", inverse, c.moments.between[:, :p, :p])
            table.append(
                (*key, *counts, fit.sigma2, fit.sigma2 * a, fit.sigma2 * fit.smooth_ratio if wiggly.stop > wiggly.start else None,
                 free, float(users.sum() - shrunk.sum() - spread.sum()))
            )
        schema = (
            f"{self.keys}, n_rows long, n_users long, residual_variance double, user_variance double, "
            "smooth_variance double, edf_curve double, edf_users double"
        )
        return self.rows.sparkSession.createDataFrame(table, schema)


def fit_all(
    df: DataFrame, by: list[str], user: str, day: str, y: str, first_day: int = -10, last_day: int = 20, size: int = 10
) -> CurveFits:
    """Fits a curve for every ``by``. Rows outside the range or with a missing value take no part.

    A curve with one day has a level, one with two days a line. The knots are the range's days, with or without rows.
    """
    rows = df.filter(F.col(day).between(first_day, last_day)).dropna(subset=[*by, user, day, y])
    rows = cut(rows.select(*by, user, F.col(day).cast("int").alias("_day"), F.col(y).cast("double").alias("_y")))
    per_day = (
        rows.groupBy(*by, "_day")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("mean"), F.var_pop("_y").alias("var"))
        .collect()
    )
    groups: dict[tuple, list] = {}
    for r in sorted(per_day, key=lambda r: r["_day"]):
        groups.setdefault(tuple(r[c] for c in by), []).append(r)
    kinds = dict(df.dtypes)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    whole = range_design(first_day, last_day, size)
    width = whole.shape[1]
    shifts = {key: float(sum(r["n"] * r["mean"] for r in s) / sum(r["n"] for r in s)) for key, s in groups.items()}
    mine: dict[tuple, list] = {key: [] for key in groups}
    if groups:
        between = _between(rows, by, user, whole, first_day, shifts)
        for r in between.limit(MOST_PRODUCTS + 1).collect():
            mine[tuple(r[c] for c in by)].append(r)
        if sum(map(len, mine.values())) > MOST_PRODUCTS:
            raise ValueError(f"more than {MOST_PRODUCTS} curves and numbers of rows of a user")
    fits = {
        key: _fit(stats, whole[[r["_day"] - first_day for r in stats]], shifts[key], mine[key], width)
        for key, stats in groups.items()
    }
    return CurveFits(by, day, keys, fits, rows)


def fit_curves(
    df: DataFrame, by: list[str], user: str, day: str, y: str, first_day: int = -10, last_day: int = 20, size: int = 10
) -> DataFrame:
    """``fit_all`` and its curves."""
    return fit_all(df, by, user, day, y, first_day, last_day, size).curves()


def _between(rows: DataFrame, by: list[str], user: str, whole: np.ndarray, first_day: int, shifts: dict) -> DataFrame:
    """Per (by..., rows of a user): users and products of the users' sums of the design's columns and of y."""
    width = whole.shape[1]
    literal = ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in row) + ")" for row in whole)
    designed = rows.withColumn("_z", F.expr(f"element_at(array({literal}), _day - ({first_day}) + 1)"))
    per_user = designed.groupBy(*by, user).agg(
        F.count(F.lit(1)).alias("n"), *[F.expr(f"sum(_z[{k}]) AS c{k}") for k in range(width)], F.sum("_y").alias("_sum")
    )
    level = F.lit(0.0)
    for key, shift in shifts.items():
        here = F.lit(True)
        for c, value in zip(by, key):
            here = here & (F.col(c) == F.lit(value))
        level = F.when(here, F.lit(shift)).otherwise(level)
    products = [F.expr(f"sum(c{i} * c{j}) AS p{i}_{j}") for i in range(width + 1) for j in range(i, width + 1)]
    centred = per_user.withColumn(f"c{width}", F.col("_sum") - F.col("n") * level)
    return centred.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("users"), *products)


def _fit(stats: list, design: np.ndarray, shift: float, between: list, width: int) -> Curve:
    fixed = min(2, len(stats))
    p = fixed if len(stats) < 3 else width
    design = design[:, :p]
    n = np.array([r["n"] for r in stats], dtype=float)
    mean = np.array([r["mean"] for r in stats])
    var = np.array([r["var"] for r in stats])
    gram = np.zeros((p + 1, p + 1))
    gram[:p, :p] = (design.T * n) @ design
    gram[:p, p] = gram[p, :p] = (design.T * n) @ (mean - shift)
    gram[p, p] = n @ (var + (mean - shift) ** 2)
    used = [*range(p), width]
    squares = np.zeros((len(between), p + 1, p + 1))
    for at, r in enumerate(between):
        for i, a in enumerate(used):
            for j, b in enumerate(used[i:], start=i):
                squares[at, i, j] = squares[at, j, i] = r[f"p{a}_{b}"]
    moments = Moments(
        gram,
        np.array([r["n"] for r in between], dtype=float),
        np.array([r["users"] for r in between], dtype=float),
        squares,
    )
    n_rows = int(n.sum())
    fit = fit_smooth(moments, n_rows, fixed) if n_rows > fixed + 1 else None
    return Curve(stats, design, shift, fixed, moments, fit)
