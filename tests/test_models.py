"""Models against dense-matrix REML written straight from the definitions, on small simulated panels."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwise.operators import mixed, reml, smooth

DAYS = ["Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]


def simulate(n_users: int = 30, seed: int = 5):
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(n_users):
        effect = rng.normal(0, 2.0)
        for day in range(int(rng.integers(3, 14))):
            week = (day - 6) / 6
            state = 60 + rng.normal(0, 1)
            weekday = DAYS[day % 7]
            y = 10 + 3 * week + 0.5 * state + (1.5 if weekday == "Sunday" else 0) + effect + rng.normal(0, 1)
            period = "baseline" if day < 7 or day > 10 else "event"
            rows.append((f"u{u}", day, week, week * week, state, weekday, period, float(y)))
    return rows


SCHEMA = "user_id string, day int, w1 double, w2 double, state double, weekday string, period string, y double"


def design(rows):
    x = np.array([[1, r[2], r[3], r[4], *[float(r[5] == d) for d in DAYS[1:]]] for r in rows])
    y = np.array([r[7] for r in rows])
    users = sorted({r[0] for r in rows})
    z = np.array([[float(r[0] == u) for u in users] for r in rows])
    return x, y, z, users


def dense_criterion(x, y, v):
    inverse = np.linalg.inv(v)
    xtx = x.T @ inverse @ x
    b = np.linalg.solve(xtx, x.T @ inverse @ y)
    r = y - x @ b
    rss = r @ inverse @ r
    n, p = x.shape
    value = (n - p) * np.log(rss) + np.linalg.slogdet(v)[1] + np.linalg.slogdet(xtx)[1]
    return value, b, rss / (n - p), np.linalg.inv(xtx)


def dense_fit(x, y, z):
    def f(logs):
        return np.array([dense_criterion(x, y, np.eye(len(y)) + np.exp(t) * z @ z.T)[0] for t in logs])

    log_ratio, value = reml.minimise(f, -8.0, 8.0, 33, 6)
    _, b, sigma2, inverse = dense_criterion(x, y, np.eye(len(y)) + np.exp(log_ratio) * z @ z.T)
    return np.exp(log_ratio), value, b, sigma2, inverse * sigma2


@pytest.fixture(scope="module")
def fitted(spark):
    rows = simulate()
    df = spark.createDataFrame(rows, SCHEMA)
    specs = [
        mixed.MixedSpec("all", "y", ["w1", "w2", "state"], "weekday"),
        mixed.MixedSpec("bl", "y", ["w1", "w2", "state"], "weekday", rows=F.col("period") == "baseline"),
    ]
    return rows, df, mixed.fit_mixed(df, "user_id", specs)


@pytest.mark.parametrize("name", ["all", "bl"])
def test_coefficients_match_dense_reml(fitted, name):
    rows, _, fits = fitted
    used = rows if name == "all" else [r for r in rows if r[6] == "baseline"]
    ratio, value, b, sigma2, cov = dense_fit(*design(used)[:3])
    fit = fits.fits[name]
    assert fit.criterion == pytest.approx(value, abs=1e-6)
    assert fit.ratio == pytest.approx(ratio, rel=1e-3)
    np.testing.assert_allclose(fit.coef, b, rtol=1e-4, atol=1e-4)
    assert fit.sigma2 == pytest.approx(sigma2, rel=1e-4)
    np.testing.assert_allclose(np.sqrt(np.diag(fit.covariance)), np.sqrt(np.diag(cov)), rtol=1e-3)


def test_known_coefficients_are_recovered(fitted):
    table = {r["term"]: r for r in fitted[2].coefficients().filter("model = 'all'").collect()}
    for term, truth in (("w1", 3.0), ("state", 0.5), ("weekdaySunday", 1.5)):
        assert abs(table[term]["estimate"] - truth) < 3 * table[term]["std_error"]


def test_effects_and_predictions_match_dense(fitted, spark):
    rows, df, fits = fitted
    x, y, z, users = design(rows)
    fit = fits.fits["all"]
    effect = fit.ratio * z.T @ np.linalg.solve(np.eye(len(y)) + fit.ratio * z @ z.T, y - x @ fit.coef)
    got = {r["user_id"]: r["effect"] for r in fits.user_effects().filter("model = 'all'").collect()}
    np.testing.assert_allclose([got[u] for u in users], effect, atol=1e-6)
    extra = spark.createDataFrame(
        [("new", 0, 0.5, 0.25, 60.0, "Friday", "event", None), ("u0", 1, None, 0.0, 60.0, "Friday", "event", 1.0)], SCHEMA
    )
    seen = {(r["user_id"], r["w1"]): r["all__predicted"] for r in fits.predict(df.unionByName(extra)).collect()}
    fixed = fit.coef @ np.array([1, 0.5, 0.25, 60.0, 0, 0, 0, 0, 0, 0])
    assert seen[("new", 0.5)] == pytest.approx(fixed)  # unseen user: effect 0
    assert seen[("u0", None)] is None  # missing predictor: no prediction
    first = rows[0]
    assert seen[("u0", first[2])] == pytest.approx(x[0] @ fit.coef + effect[users.index("u0")], abs=1e-6)


def test_baseline_effect_is_zero_without_baseline_rows(spark):
    rows = simulate(12)
    rows = [r if r[0] != "u0" else (*r[:6], "event", r[7]) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    spec = mixed.MixedSpec("bl", "y", ["w1", "w2", "state"], "weekday", rows=F.col("period") == "baseline")
    fits = mixed.fit_mixed(df, "user_id", [spec])
    r = fits.predict(df.filter("user_id = 'u0' and day = 0")).collect()[0]
    x = design([r[: len(SCHEMA.split(","))]])[0][0]
    assert r["bl__predicted"] == pytest.approx(float(x @ fits.fits["bl"].coef))


def test_the_search_finds_the_root_of_the_derivative():
    for target in (-15.7, -3.21, 0.0, 4.5, 11.9):
        search = reml.RatioSearch()
        for rounds in range(1, 6):
            x = search.points - target
            search.take(np.cosh(x / 3), np.sinh(x / 3) / 3)
            if search.found is not None:
                break
        assert search.found == pytest.approx(target, abs=1e-12) and rounds == 3
    falling = reml.RatioSearch()
    falling.take(-falling.points, -np.ones(29))
    assert falling.found == 12.0


def test_profiles_sum_any_number_of_sizes(spark):
    """20,001 sizes, no switch: the weighted products equal direct sums, and their slopes finite differences."""
    sizes = np.arange(1, 20_002)
    rows = [(m, int(n), 2, [float(n * n), float(n), 3.0]) for m in ("a", "b") for n in sizes]
    by_size = spark.createDataFrame(rows, "model string, n long, users long, products array<double>")
    gram = {"a": np.diag([1e9, 1e9]), "b": np.zeros((2, 2))}
    got = mixed.profiles(by_size, gram, {"a": [0.5], "b": [0.5, 0.5 * np.exp(1e-6)]})
    weight = 0.5 / (1 + sizes * 0.5)
    sums = np.array([[weight @ sizes**2.0, weight @ sizes], [weight @ sizes, 3 * weight.sum()]])
    np.testing.assert_allclose(got["a"][0].cross, gram["a"] - sums, rtol=1e-12)
    np.testing.assert_allclose(got["b"][0].cross, -sums, rtol=1e-12)
    assert got["a"][0].log_det == pytest.approx(2 * np.log1p(sizes * 0.5).sum())
    first, second = got["b"]
    np.testing.assert_allclose(first.slope, (second.cross - first.cross) / 1e-6, rtol=1e-5)
    assert first.log_det_slope == pytest.approx((second.log_det - first.log_det) / 1e-6, rel=1e-5)


def test_derivative_is_that_of_the_criterion():
    rng = np.random.default_rng(8)
    z = rng.normal(size=(40, 4))
    gram, between = z.T @ z, z[:5].T @ z[:5]
    at = lambda t: reml.Profile(
        gram - between * np.exp(t) / (1 + 3 * np.exp(t)), -between * np.exp(t) / (1 + 3 * np.exp(t)) ** 2,
        5 * np.log1p(3 * np.exp(t)), 15 * np.exp(t) / (1 + 3 * np.exp(t)),
    ).at(np.ix_(range(4), range(4)), 40, 3)
    for t in (-4.0, -1.0, 0.5, 2.0):
        assert at(t)[1] == pytest.approx((at(t + 1e-5)[0] - at(t - 1e-5)[0]) / 2e-5, rel=1e-5, abs=1e-7)


def test_levels_come_from_the_rows(spark):
    rows = [(*r[:5], {"Friday": "zeta", "Monday": "alpha"}.get(r[5], "mid'dle"), *r[6:]) for r in simulate(15)]
    rows += [("u0", 3, 0.1, 0.1, 60.0, "only missing", "event", None), ("u1", 4, 0.1, 0.1, 60.0, None, "event", 1.0)]
    rows = [(*r[:5], "late" if r[6] == "event" and r[5] == "zeta" else r[5], *r[6:]) for r in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    all_days = mixed.MixedSpec("all", "y", ["w1", "w2", "state"], "weekday")
    base = mixed.MixedSpec("bl", "y", ["w1", "w2", "state"], "weekday", rows=F.col("period") == "baseline")
    resolved = {s.name: s.levels for s in mixed.with_levels(df, "user_id", [all_days, base])}
    assert resolved["bl"] == ["alpha", "mid'dle", "zeta"]
    assert resolved["all"] == sorted({r[5] for r in rows if r[7] is not None and r[5]})
    together = mixed.fit_mixed(df, "user_id", [all_days, base])
    alone = mixed.fit_mixed(df, "user_id", [base])
    terms = lambda fits: {
        r["term"]: (r["estimate"], r["std_error"]) for r in fits.coefficients().filter("model = 'bl'").collect()
    }
    assert set(terms(together)) == set(terms(alone)) and "weekdayalpha" not in terms(alone)
    for term, (estimate, error) in terms(alone).items():
        assert terms(together)[term] == (pytest.approx(estimate, rel=1e-8, abs=1e-9), pytest.approx(error, rel=1e-8))


def test_levels_are_bounded_and_given_ones_are_checked(spark, monkeypatch):
    df = spark.createDataFrame(simulate(15), SCHEMA)
    spec = mixed.MixedSpec("all", "y", ["w1", "w2", "state"], "weekday")
    monkeypatch.setattr(mixed, "MOST_LEVELS", 3)
    with pytest.raises(ValueError, match="more than 3 levels"):
        mixed.fit_mixed(df, "user_id", [spec])
    monkeypatch.undo()
    narrow = mixed.MixedSpec("all", "y", ["w1", "w2", "state"], "weekday", levels=DAYS[:6])
    with pytest.raises(Exception, match="unknown level of weekday"):
        mixed.fit_mixed(df, "user_id", [narrow])


def test_constant_terms_are_dropped(spark):
    rows = [(*r[:3], 7.0, *r[4:]) for r in simulate(15)]
    df = spark.createDataFrame(rows, SCHEMA)
    fits = mixed.fit_mixed(df, "user_id", [mixed.MixedSpec("all", "y", ["w1", "w2", "state"], "weekday")])
    table = {r["term"]: r for r in fits.coefficients().collect()}
    assert table["w2"]["std_error"] is None and table["w2"]["estimate"] == 0.0
    assert table["w1"]["std_error"] > 0


def test_users_of_equal_size_and_no_user_effect(spark):
    rng = np.random.default_rng(3)
    rows = []
    for u in range(20):
        for day in range(7):
            rows.append((f"u{u}", day, day / 6, (day / 6) ** 2, 60 + rng.normal(), DAYS[day], "event", rng.normal() - (u % 2) * 0))
    means = {u: np.mean([r[7] for r in rows if r[0] == u]) for u in {r[0] for r in rows}}
    rows = [(*r[:7], float(r[7] - means[r[0]])) for r in rows]  # users' means are equal: the ratio is at its bound
    df = spark.createDataFrame(rows, SCHEMA)
    fits = mixed.fit_mixed(df, "user_id", [mixed.MixedSpec("all", "y", ["w1", "w2", "state"], "weekday")])
    assert fits.fits["all"].ratio == 0.0
    assert fits.user_effects().filter("effect <> 0").count() == 0


# --- smooth curves ---------------------------------------------------------------------------------------


def curve_rows(seed: int = 2, n_users: int = 25):
    rng = np.random.default_rng(seed)
    rows = []
    for group, height in (("a", 5.0), ("b", -3.0)):
        for u in range(n_users):
            effect = rng.normal(0, 1.5)
            for day in range(-10, 21):
                if rng.random() < 0.6:
                    y = height * np.exp(-((day - 2) ** 2) / 18) + effect + rng.normal(0, 1)
                    rows.append((group, f"{group}{u}", day, float(y)))
    return rows


def test_curve_matches_dense_fit(spark):
    rows = curve_rows()
    df = spark.createDataFrame(rows, "cohort string, user_id string, day int, y double")
    outside = spark.createDataFrame([("a", "a0", 40, 99.0), ("a", "a0", 3, None)], df.schema)
    got = smooth.fit_curves(df.unionByName(outside), ["cohort"], "user_id", "day", "y").collect()
    for group in ("a", "b"):
        mine = [r for r in rows if r[0] == group]
        days = np.array(sorted({r[2] for r in mine}))
        basis = smooth.thin_plate_basis(days)
        assert basis.shape == (31, 8)
        at = {day: i for i, day in enumerate(days)}
        b = np.array([basis[at[r[2]]] for r in mine])
        x = np.array([[1.0, r[2]] for r in mine])
        y = np.array([r[3] for r in mine])
        users = sorted({r[1] for r in mine})
        z = np.array([[float(r[1] == u) for u in users] for r in mine])
        best = None
        for lu in np.linspace(-3, 4, 12):
            for ls in np.linspace(-6, 8, 12):
                v = np.eye(len(y)) + np.exp(lu) * z @ z.T + np.exp(ls) * b @ b.T
                value = dense_criterion(x, y, v)[0]
                if best is None or value < best[0]:
                    best = (value, lu, ls)
        curve = sorted((r for r in got if r["cohort"] == group), key=lambda r: r["day"])
        assert [r["day"] for r in curve] == list(days)
        for _ in range(5):  # refine around the coarse best
            step = 0.7 * 0.5**_
            for lu in np.linspace(best[1] - step, best[1] + step, 5):
                for ls in np.linspace(best[2] - step, best[2] + step, 5):
                    v = np.eye(len(y)) + np.exp(lu) * z @ z.T + np.exp(ls) * b @ b.T
                    value = dense_criterion(x, y, v)[0]
                    if value < best[0]:
                        best = (value, lu, ls)
        _, lu, ls = best
        v = np.eye(len(y)) + np.exp(lu) * z @ z.T
        w = np.linalg.inv(v)
        full = np.column_stack([x, b])
        penalty = np.diag([0.0, 0.0] + [np.exp(-ls)] * 8)
        inverse = np.linalg.inv(full.T @ w @ full + penalty)
        coef = inverse @ full.T @ w @ y
        sigma2 = dense_criterion(x, y, v + np.exp(ls) * b @ b.T)[2]
        new = np.column_stack([np.ones(31), days, basis])
        np.testing.assert_allclose([r["fit"] for r in curve], new @ coef, atol=0.02)
        se = np.sqrt(sigma2 * np.einsum("ij,jk,ik->i", new, inverse, new))
        np.testing.assert_allclose([r["se"] for r in curve], se, rtol=0.02)
        means = [np.mean([r[3] for r in mine if r[2] == day]) for day in days]
        np.testing.assert_allclose([r["mean_y"] for r in curve], means, atol=1e-9)
        assert all(r["low"] == pytest.approx(r["fit"] - r["se"]) for r in curve)


def test_smooth_user_effects_do_not_shift_the_curve(spark):
    # the curve is the population's: each user's level is left out
    rows = [("a", f"u{u}", day, float(10 * (u % 2) + 0.1 * ((u + day) % 3))) for u in range(10) for day in range(-10, 21)]
    df = spark.createDataFrame(rows, "cohort string, user_id string, day int, y double")
    curve = smooth.fit_curves(df, ["cohort"], "user_id", "day", "y").collect()
    assert all(abs(r["fit"] - 5.1) < 0.2 for r in curve)


def test_few_days_fall_back_to_simple_curves(spark):
    rows = [("one", f"u{u}", 0, float(u)) for u in range(5)]
    rows += [("two", f"u{u}", d, float(u + d)) for u in range(5) for d in (0, 1)]
    df = spark.createDataFrame(rows, "cohort string, user_id string, day int, y double")
    curve = {(r["cohort"], r["day"]): r["fit"] for r in smooth.fit_curves(df, ["cohort"], "user_id", "day", "y").collect()}
    assert curve[("one", 0)] == pytest.approx(2.0, abs=1e-6)
    assert curve[("two", 1)] - curve[("two", 0)] == pytest.approx(1.0, abs=1e-6)


def test_effective_degrees_of_freedom_are_traces_of_the_influence_matrix(spark):
    rows = curve_rows(seed=4, n_users=14)
    df = spark.createDataFrame(rows, "cohort string, user_id string, day int, y double")
    fits = smooth.fit_all(df, ["cohort"], "user_id", "day", "y")
    for r in fits.summary().collect():
        mine = [x for x in rows if x[0] == r["cohort"]]
        design = smooth.range_design(-10, 20)
        users = sorted({x[1] for x in mine})
        x = np.array([design[d[2] + 10] for d in mine])
        z = np.array([[float(d[1] == u) for u in users] for d in mine])
        full = np.column_stack([x, z])
        fit = fits.fits[(r["cohort"],)].fit
        penalty = np.diag([0.0, 0.0, *[1 / fit.smooth_ratio] * 8, *[1 / fit.user_ratio] * len(users)])
        influence = np.linalg.solve(full.T @ full + penalty, full.T @ full)
        trace = np.diag(influence)
        assert r["edf_curve"] == pytest.approx(trace[1:10].sum(), rel=1e-6)
        assert r["edf_users"] == pytest.approx(trace[10:].sum(), rel=1e-6)
        assert (r["n_rows"], r["n_users"]) == (len(mine), len(users))
        assert r["user_variance"] == pytest.approx(fit.sigma2 * fit.user_ratio)


def test_slopes_are_those_of_the_surface(spark):
    rows = curve_rows(seed=6, n_users=10)
    df = spark.createDataFrame(rows, "cohort string, user_id string, day int, y double")
    c = smooth.fit_all(df, ["cohort"], "user_id", "day", "y").fits[("a",)]
    surface = reml._Surface(c.moments, int(sum(r["n"] for r in c.stats)), c.fixed)
    h = 1e-5
    for a, t in ((-3.0, 2.0), (0.5, -4.0), (1.0, 6.0)):
        value = lambda x, y: surface.value(np.array([x]), np.array([y]))[0]
        assert surface.user_slope(np.array([a]), t)[0] == pytest.approx((value(a + h, t) - value(a - h, t)) / (2 * h), rel=1e-4, abs=1e-4)
        assert surface.smooth_slope(a, t) == pytest.approx((value(a, t + h) - value(a, t - h)) / (2 * h), rel=1e-4, abs=1e-4)
    at = np.log([c.fit.user_ratio, c.fit.smooth_ratio])
    assert abs(surface.user_slope(at[:1], at[1])[0]) < 1e-6 and abs(surface.smooth_slope(*at)) < 1e-6


def test_curves_with_missing_days_and_too_many_products(spark, monkeypatch):
    rows = [r for r in curve_rows(seed=3, n_users=12) if r[2] % 3]
    df = spark.createDataFrame(rows, "cohort string, user_id string, day int, y double")
    curve = smooth.fit_curves(df, ["cohort"], "user_id", "day", "y").collect()
    assert {r["day"] for r in curve} == {d for d in range(-10, 21) if d % 3}
    peak = max((r for r in curve if r["cohort"] == "a"), key=lambda r: r["fit"])
    assert abs(peak["day"] - 2) <= 3
    monkeypatch.setattr(smooth, "MOST_PRODUCTS", 2)
    with pytest.raises(ValueError, match="more than 2 curves"):
        smooth.fit_curves(df, ["cohort"], "user_id", "day", "y")
    empty = smooth.fit_all(df.limit(0), ["cohort"], "user_id", "day", "y")
    assert empty.curves().collect() == [] and empty.summary().collect() == []
