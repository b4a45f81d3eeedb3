"""Tail areas of the normal and chi-square distributions as column expressions (no Python workers)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_SWITCH = 2.5  # below: power series; above: continued fraction


def erfc(x: Column) -> Column:
    """Complementary error function for ``x >= 0``."""
    near = F.least(x, F.lit(_SWITCH))
    first = F.lit(2.0 / math.sqrt(math.pi)) * near * F.exp(-near * near)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(70)),
        F.struct(first.alias("term"), first.alias("sum")),
        lambda acc, n: F.struct(
            (acc["term"] * 2.0 * near * near / (2.0 * n + 1.0)).alias("term"),
            (acc["sum"] + acc["term"] * 2.0 * near * near / (2.0 * n + 1.0)).alias("sum"),
        ),
        lambda acc: 1.0 - acc["sum"],
    )
    far = F.greatest(x, F.lit(_SWITCH))
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), far, lambda f, k: far + k / 2.0 / f)
    tail = F.exp(-far * far) / F.lit(math.sqrt(math.pi)) / fraction
    return F.when(x < _SWITCH, series).when(x.isNotNull(), tail)


def normal_upper(z: Column) -> Column:
    """Area above ``z`` under the standard normal curve."""
    half = erfc(F.abs(z) / F.lit(math.sqrt(2.0))) / 2.0
    return F.when(z >= 0, half).when(z < 0, 1.0 - half)


def normal_two_sided(z: Column) -> Column:
    """Area beyond ``+-z``."""
    return erfc(F.abs(z) / F.lit(math.sqrt(2.0)))


def chi_square_upper(x: Column, dof: Column) -> Column:
    """Area above ``x`` for a whole number of degrees of freedom.

    Finite sum of Poisson-like terms, plus an error-function term when ``dof`` is odd. The terms are kept as
    logarithms, so a large statistic with many degrees of freedom neither overflows nor vanishes.
    """
    h = F.greatest(x / 2.0, F.lit(1e-300))
    odd = dof % 2 == 1
    terms = F.floor(dof / 2).cast("int")
    half = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    # log of the first term: h^0/0! (even) or h^(1/2)/Gamma(3/2) (odd), both times exp(-h)
    start = -h + F.when(odd, F.log(h) / 2.0 - F.lit(math.lgamma(1.5))).otherwise(F.lit(0.0))
    steps = F.when(terms > 1, F.sequence(F.lit(1), terms - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(
        steps,
        F.struct(start.alias("log_term"), F.exp(start).alias("sum")),
        lambda acc, i: F.struct(
            (acc["log_term"] + F.log(h / (i + half))).alias("log_term"),
            (acc["sum"] + F.exp(acc["log_term"] + F.log(h / (i + half)))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    summed = F.when(terms > 0, total).otherwise(F.lit(0.0))
    area = summed + F.when(odd, erfc(F.sqrt(h))).otherwise(F.lit(0.0))
    return F.when((x > 0) & (dof > 0), F.least(area, F.lit(1.0))).when(x.isNotNull() & (dof >= 0), F.lit(1.0))
