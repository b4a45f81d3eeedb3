"""Random-intercept models of panel outcomes, fitted from Spark aggregations.

One pass over the panel sums the model columns per user; a second sums centred cross products per level of
the categorical term. Several models are fitted from the same passes, and searched together: a round of the search
is one Spark job over the distinct numbers of rows of a user, and gives the driver a small matrix per model and ratio.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.operators.reml import Fit, Profile, fit_intercepts
from panelwise.session import cut

#: A categorical term gets a coefficient for each level, and the driver a matrix of their products.
MOST_LEVELS = 500


@dataclass(frozen=True)
class MixedSpec:
    """``outcome ~ numeric terms + factor + (1 | user)`` on the rows that meet ``rows``.

    The first level of the factor is the reference level. Without ``levels`` they are those of the model's
    complete rows, in the order of their names; levels that are given must cover all of them.
    """

    name: str
    outcome: str
    numeric: list[str]
    factor: str
    levels: list[str] = field(default_factory=list)
    rows: Column | None = None


@dataclass(frozen=True)
class MixedFits:
    user: str
    specs: list[MixedSpec]
    fits: dict[str, Fit]
    counts: dict[str, tuple[int, int]]
    user_sums: DataFrame

    def terms(self, spec: MixedSpec) -> list[str]:
        return ["(Intercept)", *spec.numeric, *[f"{spec.factor}{level}" for level in spec.levels[1:]]]

    def coefficients(self) -> DataFrame:
        """One row per model and term; a term that the data cannot tell apart has no standard error."""
        rows = []
        for spec in self.specs:
            fit = self.fits[spec.name]
            errors = np.sqrt(np.diag(fit.covariance))
            for term, b, se in zip(self.terms(spec), fit.coef, errors):
                known = bool(np.isfinite(se) and se > 0)
                rows.append((spec.name, term, float(b), float(se) if known else None, float(b / se) if known else None))
        schema = "model string, term string, estimate double, std_error double, t_value double"
        return self.user_sums.sparkSession.createDataFrame(rows, schema)

    def variances(self) -> DataFrame:
        rows = [
            (name, *self.counts[name], fit.sigma2, fit.sigma2 * fit.ratio, fit.criterion)
            for name, fit in self.fits.items()
        ]
        schema = (
            "model string, n_rows long, n_users long, residual_variance double, user_variance double, "
            "criterion double"
        )
        return self.user_sums.sparkSession.createDataFrame(rows, schema)

    def user_effects(self) -> DataFrame:
        """``(model, user, effect)``: the predicted intercept of every user in the fit."""
        cases = []
        for spec in self.specs:
            fit = self.fits[spec.name]
            sums = ["n", *[f"s_{j}" for j in range(len(spec.numeric))], *[f"d_{k}" for k in range(len(spec.levels) - 1)]]
            expected = " + ".join(f"{c} * {_number(b)}" for c, b in zip(sums, fit.coef))
            shrink = f"{_number(fit.ratio)} / (1 + n * {_number(fit.ratio)})"
            cases.append((spec.name, f"{shrink} * (s_y - ({expected}))"))
        return self.user_sums.select("model", self.user, _per_model(cases).alias("effect"))

    def fixed_part(self, spec: MixedSpec) -> Column:
        """Population prediction; null when a predictor is missing or its level is unknown."""
        b = self.fits[spec.name].coef
        q = len(spec.numeric)
        slopes = "".join(f" + `{c}` * {_number(x)}" for c, x in zip(spec.numeric, b[1:]))
        steps = [F.lit(x) for k, name in enumerate(spec.levels) for x in (name, 0.0 if k == 0 else float(b[q + k]))]
        return F.expr(_number(b[0]) + slopes) + F.create_map(*steps)[F.col(spec.factor)]

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds ``<model>__predicted``; users outside a fit get its population prediction.

        The effects of all models come in one join on the user. They are written before it, so that the adaptive
        skew join can split a user with very many rows.
        """
        names = [spec.name for spec in self.specs]
        wide = cut(
            self.user_effects()
            .groupBy(self.user)
            .agg(*[F.max(F.when(F.col("model") == m, F.col("effect"))).alias(f"_{m}") for m in names])
        )
        added = [
            (self.fixed_part(spec) + F.coalesce(f"_{spec.name}", F.lit(0.0))).alias(f"{spec.name}__predicted")
            for spec in self.specs
        ]
        return df.join(wide, self.user, "left").select(*df.columns, *added)


def _number(x: float) -> str:
    return f"({float(x)!r}D)"


def _text(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _per_model(cases: list[tuple[str, str]]) -> Column:
    """An SQL expression per model."""
    chosen = F.when(F.col("model") == cases[0][0], F.expr(cases[0][1]))
    for name, expression in cases[1:]:
        chosen = chosen.when(F.col("model") == name, F.expr(expression))
    return chosen


def model_rows(
    df: DataFrame, user: str, specs: list[MixedSpec], means: dict[str, list[float]] | None = None
) -> DataFrame:
    """Long form ``(model, user, level, x_0.., y)`` of the complete rows of every model.

    With ``means`` (numeric terms, then the outcome) per model, x and y are differences from them. A complete row
    whose factor is none of the model's levels is an error, not left out.
    """
    entries = []
    for spec in specs:
        columns = [*spec.numeric, spec.outcome]
        shifts = means[spec.name] if means else [0.0] * len(columns)
        complete = " AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in columns)
        needed = F.expr(f"`{user}` IS NOT NULL AND {complete}") & F.col(spec.factor).isNotNull()
        if spec.rows is not None:
            needed = needed & spec.rows
        names = [*[f"x_{j}" for j in range(len(spec.numeric))], "y"]
        fields = ", ".join(f"`{c}` - {_number(m)} AS {name}" for c, m, name in zip(columns, shifts, names))
        known = ", ".join(_text(level) for level in spec.levels)
        level = f"`{spec.factor}`"
        if spec.levels:
            level = (
                f"CASE WHEN {level} IN ({known}) THEN {level} "
                f"ELSE raise_error(concat('unknown level of {spec.factor}: ', {level})) END"
            )
        row = F.expr(f"struct({level} AS level, {fields})")
        entries.append(F.when(needed, F.struct(F.lit(spec.name).alias("model"), row.alias("row"))))
    return df.select(user, F.inline(F.array_compact(F.array(*entries)))).select("model", user, "row.*")


def model_levels(df: DataFrame, user: str, specs: list[MixedSpec]) -> DataFrame:
    """``(model, level, n, position)``: levels of each model's complete rows by name, the reference level at 0."""
    bare = [dataclasses.replace(spec, levels=[]) for spec in specs]
    counted = model_rows(df, user, bare).groupBy("model", "level").agg(F.count(F.lit(1)).alias("n"))
    by_name = Window.partitionBy("model").orderBy("level")  # one row per level
    return counted.withColumn("position", F.row_number().over(by_name) - 1)


def with_levels(df: DataFrame, user: str, specs: list[MixedSpec]) -> list[MixedSpec]:
    """The models with their levels: those without any get the levels of their rows, by one aggregate for all."""
    bare = [spec for spec in specs if not spec.levels]
    if not bare:
        return specs
    found: dict[str, list[str]] = {spec.name: [] for spec in bare}
    for r in model_levels(df, user, bare).filter(F.col("position") <= MOST_LEVELS).orderBy("model", "position").collect():
        found[r["model"]].append(r["level"])
    for spec in bare:
        if len(found[spec.name]) > MOST_LEVELS:
            raise ValueError(f"{spec.factor} has more than {MOST_LEVELS} levels in {spec.name}")
        if not found[spec.name]:
            raise ValueError(f"no complete rows for {spec.name}")
    return [dataclasses.replace(s, levels=found[s.name]) if not s.levels else s for s in specs]


def user_moments(rows: DataFrame, user: str, specs: list[MixedSpec]) -> DataFrame:
    """Per (model, user): number of rows and sums of all model columns; a model with fewer levels has zeros."""

    def in_level(k: int) -> Column:
        names = {spec.name: spec.levels[k] for spec in specs if k < len(spec.levels)}
        if len(set(names.values())) == 1 and len(names) == len(specs):
            return F.col("level") == specs[0].levels[k]
        return F.col("level") == F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("model")]

    return rows.groupBy("model", user).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"x_{j}").alias(f"s_{j}") for j in range(len(specs[0].numeric))],
        *[F.count_if(in_level(k + 1)).alias(f"d_{k}") for k in range(dummies(specs))],
        F.sum("y").alias("s_y"),
    )


def dummies(specs: list[MixedSpec]) -> int:
    return max(len(spec.levels) for spec in specs) - 1


def column_totals(sums: DataFrame, terms: int) -> dict:
    """Per model: rows, users, distinct numbers of rows per user, and sums of the numeric columns and y."""
    columns = [*[f"s_{j}" for j in range(terms)], "s_y"]
    totals = sums.groupBy("model").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("users"), F.countDistinct("n").alias("sizes"),
        *[F.sum(c).alias(c) for c in columns],
    )
    return {r["model"]: r for r in totals.collect()}


def column_means(totals: dict, terms: int) -> dict[str, list[float]]:
    columns = [*[f"s_{j}" for j in range(terms)], "s_y"]
    return {m: [r[c] / r["n"] for c in columns] for m, r in totals.items()}


def fit_mixed(df: DataFrame, user: str, specs: list[MixedSpec]) -> MixedFits:
    """Fits all models; they must share the number of numeric terms. Their levels may differ."""
    terms = len(specs[0].numeric)
    if any(len(s.numeric) != terms for s in specs):
        raise ValueError("models fitted together need equally many numeric terms")
    specs = with_levels(df, user, specs)
    sums = cut(user_moments(model_rows(df, user, specs), user, specs))

    totals = column_totals(sums, terms)
    missing = [s.name for s in specs if s.name not in totals]
    if missing:
        raise ValueError(f"no complete rows for {missing}")
    means = column_means(totals, terms)
    grams = _grams(model_rows(df, user, specs, means), specs)
    by_size = cut(_as_lists(size_products(sums, means, terms, dummies(specs)), terms + dummies(specs) + 2))
    found = fit_intercepts(grams, {m: r["n"] for m, r in totals.items()}, lambda ratios: profiles(by_size, grams, ratios))

    fits = {spec.name: _uncentre(found[spec.name], means[spec.name], terms) for spec in specs}
    counts = {spec.name: (totals[spec.name]["n"], totals[spec.name]["users"]) for spec in specs}
    return MixedFits(user, specs, fits, counts, sums)


def level_products(rows: DataFrame, terms: int) -> DataFrame:
    """Per (model, factor level): rows, sums ``z`` and products ``p`` of the (centred) numeric columns and y."""
    z = [*[f"x_{j}" for j in range(terms)], "y"]
    return rows.groupBy("model", "level").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.expr(f"sum({c}) AS z{i}") for i, c in enumerate(z)],
        *[F.expr(f"sum({z[i]} * {z[j]}) AS p{i}_{j}") for i in range(terms + 1) for j in range(i, terms + 1)],
    )


def _grams(rows: DataFrame, specs: list[MixedSpec]) -> dict[str, np.ndarray]:
    """Cross products of centred rows per model, assembled from sums per factor level.

    Grouping by level replaces all products with indicator columns; columns are 1, numeric, levels, y.
    """
    terms, levels = len(specs[0].numeric), {spec.name: spec.levels for spec in specs}
    pairs = [(i, j) for i in range(terms + 1) for j in range(i, terms + 1)]
    summed = level_products(rows, terms).collect()
    width = terms + dummies(specs) + 2
    place = [*range(1, terms + 1), width - 1]
    grams = {spec.name: np.zeros((width, width)) for spec in specs}
    for r in summed:
        g = grams[r["model"]]
        k = levels[r["model"]].index(r["level"])
        dummy = None if k == 0 else terms + k
        g[0, 0] += r["n"]
        if dummy is not None:
            g[dummy, dummy] += r["n"]
            g[0, dummy] += r["n"]
            g[dummy, 0] += r["n"]
        for i, at in enumerate(place):
            for left in [0] + ([dummy] if dummy is not None else []):
                g[left, at] += r[f"z{i}"]
                g[at, left] += r[f"z{i}"]
        for i, j in pairs:
            g[place[i], place[j]] += r[f"p{i}_{j}"]
            if i != j:
                g[place[j], place[i]] += r[f"p{i}_{j}"]
    return grams


def size_products(sums: DataFrame, means: dict[str, list[float]], terms: int, indicators: int) -> DataFrame:
    """Per (model, rows per user): number of users and products of the users' centred sums."""
    centred = [
        _per_model([(m, f"{c} - n * {_number(v[j])}") for m, v in means.items()])
        for j, c in enumerate([*[f"s_{j}" for j in range(terms)], "s_y"])
    ]
    dummy = [F.expr(f"double(d_{k})") for k in range(indicators)]
    columns = [F.expr("double(n)"), *centred[:terms], *dummy, centred[terms]]
    width = len(columns)
    return (
        sums.select("model", "n", *[c.alias(f"c{i}") for i, c in enumerate(columns)])
        .groupBy("model", "n")
        .agg(
            F.count(F.lit(1)).alias("users"),
            *[F.expr(f"sum(c{i} * c{j}) AS b{i}_{j}") for i in range(width) for j in range(i, width)],
        )
    )


def _as_lists(by_size: DataFrame, width: int) -> DataFrame:
    """The products of each size in one list, upper triangle by rows."""
    products = [f"b{i}_{j}" for i in range(width) for j in range(i, width)]
    return by_size.select("model", "n", "users", F.array(*products).alias("products"))


def profiles(
    by_size: DataFrame, grams: dict[str, np.ndarray], ratios: dict[str, list[float]]
) -> dict[str, list[Profile]]:
    """Weighted cross products of every model at each of its variance ratios, with their slopes in the log ratio.

    One job for all models and ratios; it sums over the distinct sizes where they are, so any number of them will do.
    """
    points = ", ".join(
        f"{_text(m)}, array({', '.join(f'struct({k} AS k, {_number(v)} AS ratio)' for k, v in enumerate(values))})"
        for m, values in ratios.items()
    )
    spread = by_size.selectExpr("*", f"inline(map({points})[model])").selectExpr(
        "*", "n * ratio AS seen", "ratio / (1 + n * ratio) AS weight"
    )
    terms = (
        "posexplode(concat(transform(products, b -> struct(weight * b AS sum, weight / (1 + seen) * b AS slope)), "
        "array(struct(users * log1p(seen) AS sum, users * seen / (1 + seen) AS slope)))) AS (at, term)"
    )
    summed = spread.selectExpr("model", "k", terms).groupBy("model", "k", "at").agg(
        F.sum("term.sum").alias("sum"), F.sum("term.slope").alias("slope")
    )
    held = {(m, k): ({}, {}) for m, values in ratios.items() for k in range(len(values))}
    for r in summed.collect():
        at = held[r["model"], r["k"]]
        at[0][r["at"]], at[1][r["at"]] = r["sum"], r["slope"]
    out: dict[str, list[Profile]] = {}
    for (model, _), (sums, slopes) in held.items():
        upper = np.triu_indices(len(grams[model]))
        sides = []
        for values in (sums, slopes):
            square = np.zeros_like(grams[model])
            square[upper] = [values[i] for i in range(len(upper[0]))]
            sides.append(square + np.triu(square, 1).T)
        last = len(upper[0])
        out.setdefault(model, []).append(Profile(grams[model] - sides[0], -sides[1], sums[last], slopes[last]))
    return out


def _uncentre(fit: Fit, means: list[float], terms: int) -> Fit:
    """Back from centred columns: only the intercept and its covariances change."""
    x_mean = np.array(means[:terms])
    change = np.eye(len(fit.coef))
    change[0, 1 : terms + 1] = -x_mean
    known = np.isfinite(np.diag(fit.covariance))
    coef = change @ fit.coef
    coef[0] += means[terms]
    cov = np.full_like(fit.covariance, np.nan)
    part = np.ix_(known, known)
    cov[part] = change[part] @ fit.covariance[part] @ change[part].T
    return Fit(coef, cov, fit.sigma2, fit.ratio, fit.criterion)


def impute(df: DataFrame, channels: list[str], suffix: str = "__predicted") -> DataFrame:
    """Adds ``<c>__imputed`` (valid users only) and the flag ``<c>__was_imputed``, missing where validity is unknown."""
    added = []
    for c in channels:
        valid, seen = F.col(f"valid_user__{c}") == 1, F.col(f"{c}__observed")
        added.append(F.when(valid, F.coalesce(seen, F.col(f"{c}{suffix}"))).alias(f"{c}__imputed"))
        filled = valid & ((F.col(f"valid_day__{c}") != 1) | seen.isNull())
        added.append(F.when(filled, 1).when(~filled, 0).alias(f"{c}__was_imputed"))
    return df.select("*", *added)


def residuals(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds ``name = observed - predicted`` for each ``name: (observed, predicted)``."""
    return df.select("*", *[(F.col(a) - F.col(b)).alias(name) for name, (a, b) in pairs.items()])
