"""Restricted maximum likelihood on cross-product matrices (driver side, sizes fixed by the model).

Everything here works on matrices of (number of terms)^2 entries that Spark has already summed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Moments:
    """Sums for ``y = X b + u[user] + e``; the last column of every matrix is y.

    ``gram``: sum over rows of z z'. For each distinct number of rows per user: ``size``, ``users`` with that
    many rows, and ``between``, the sum over these users of (sum z)(sum z)'.
    """

    gram: np.ndarray
    size: np.ndarray
    users: np.ndarray
    between: np.ndarray

    def weighted(self, ratio: float) -> tuple[np.ndarray, float]:
        """Cross products under a variance ratio user/residual, and the log determinant that goes with them."""
        weight = ratio / (1.0 + self.size * ratio)
        return self.gram - np.tensordot(weight, self.between, 1), float(self.users @ np.log1p(self.size * ratio))


def independent(gram: np.ndarray, tolerance: float = 1e-9) -> list[int]:
    """Columns that are not combinations of earlier ones (pivots of a running elimination)."""
    left = gram.astype(float).copy()
    keep = []
    for j in range(len(left)):
        if left[j, j] > tolerance * max(gram[j, j], 1e-300) and left[j, j] > 0:
            keep.append(j)
            left = left - np.outer(left[:, j], left[j]) / left[j, j]
    return keep


def minimise(f: Callable[[np.ndarray], np.ndarray], low: float, high: float, points: int, rounds: int):
    """Smallest value of a vectorised function: an even grid, then finer ones around the best point."""
    best = None
    for _ in range(rounds):
        grid = np.linspace(low, high, points)
        values = f(grid)
        i = int(np.nanargmin(values))
        if best is None or values[i] <= best[1]:
            best = (grid[i], values[i])
        step = grid[1] - grid[0]
        low, high, points = best[0] - step, best[0] + step, 11
    return best


@dataclass(frozen=True)
class Fit:
    coef: np.ndarray
    covariance: np.ndarray
    sigma2: float
    ratio: float
    criterion: float


def profile(cross: np.ndarray, log_det: float, n_rows: int, p: int) -> tuple[float, np.ndarray, np.ndarray, float]:
    """-2 log restricted likelihood (up to a constant), coefficients, inverse and residual variance."""
    xx, xy, yy = cross[:p, :p], cross[:p, p], cross[p, p]
    inverse = np.linalg.pinv(xx, hermitian=True)
    coef = inverse @ xy
    rss = max(float(yy - xy @ coef), 1e-300)
    criterion = (n_rows - p) * np.log(rss) + log_det + np.linalg.slogdet(xx)[1]
    return criterion, coef, inverse, rss / (n_rows - p)


@dataclass(frozen=True)
class Profile:
    """Cross products and log determinant at one variance ratio, and the slopes of both in the log ratio."""

    cross: np.ndarray
    slope: np.ndarray
    log_det: float
    log_det_slope: float

    def at(self, pick: tuple, n_rows: int, p: int) -> tuple[float, float]:
        """The criterion and its derivative in the log ratio, by the slopes of its three parts."""
        cross, slope = self.cross[pick], self.slope[pick]
        value, coef, inverse, sigma2 = profile(cross, self.log_det, n_rows, p)
        residual = np.append(-coef, 1.0)  # moving the coefficients changes nothing at first order
        return value, residual @ slope @ residual / sigma2 + self.log_det_slope + float(np.sum(inverse * slope[:p, :p]))


class RatioSearch:
    """The log variance ratio of one model at which its criterion is least, asked for a list of points a round.

    An even grid finds the interval; then polynomials through the derivative at Chebyshev points, whose root is found to
    rounding error in two rounds.
    """

    LOW, HIGH, GRID, NODES = -16.0, 12.0, 29, 9

    def __init__(self):
        self.points = np.linspace(self.LOW, self.HIGH, self.GRID)
        self.found: float | None = None
        self._rounds = 0

    def take(self, values: np.ndarray, slopes: np.ndarray) -> None:
        x = self.points
        if self._rounds == 0:
            best = int(np.nanargmin(values))
            low = best - 1 if slopes[best] > 0 else best
            if low < 0 or low + 1 >= len(x):
                self.found = float(x[best])
                return
        else:
            crossing = np.flatnonzero((slopes[:-1] <= 0) & (slopes[1:] > 0))
            if not len(crossing) or self._rounds > 30:
                self.found = float(x[int(np.nanargmin(np.abs(slopes)))])
                return
            low = int(crossing[0])
        a, b = float(x[low]), float(x[low + 1])
        if self._rounds:
            root = _root(x, slopes, a, b)
            if x[-1] - x[0] < 1e-3:
                self.found = root
                return
            a, b = max(a, root - 1e-4), min(b, root + 1e-4)
        self._rounds += 1
        turn = np.cos(np.pi * np.arange(self.NODES) / (self.NODES - 1))
        self.points = (a + b) / 2 - (b - a) / 2 * turn


def _root(x: np.ndarray, y: np.ndarray, low: float, high: float) -> float:
    """Where the polynomial through the points crosses zero between two of them."""
    gaps = x[:, None] - x[None, :]
    np.fill_diagonal(gaps, 1.0)
    scale = x[-1] - x[0]
    weight = 1.0 / np.prod(gaps / scale, axis=1)
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        away = middle - x
        at = y[away == 0][0] if (away == 0).any() else (weight / away) @ y / (weight / away).sum()
        low, high = (middle, high) if at <= 0 else (low, middle)
    return (low + high) / 2


def fit_intercepts(
    grams: dict[str, np.ndarray], n_rows: dict[str, int],
    weighted: Callable[[dict[str, list[float]]], dict[str, list[Profile]]],
) -> dict[str, Fit]:
    """Random-intercept models: one search over the variance ratio for all of them, round by round.

    ``weighted`` gives the profiles of every model at a list of ratios; a round asks it once, for the models that are
    not settled yet.
    """
    keep, pick = {}, {}
    for name, gram in grams.items():
        p = len(gram) - 1
        keep[name] = independent(gram[:p, :p])
        pick[name] = np.ix_([*keep[name], p], [*keep[name], p])
        if n_rows[name] <= len(keep[name]):
            raise ValueError("more terms than rows")
    searches = {name: RatioSearch() for name in grams}
    while open_ := {m: s for m, s in searches.items() if s.found is None}:
        asked = weighted({m: np.exp(s.points).tolist() for m, s in open_.items()})
        for m, s in open_.items():
            values = [p.at(pick[m], n_rows[m], len(keep[m])) for p in asked[m]]
            s.take(np.array([v for v, _ in values]), np.array([d for _, d in values]))
    last = weighted({m: [float(np.exp(s.found))] for m, s in searches.items()})
    return {
        m: _settled(grams[m], last[m][0], float(np.exp(searches[m].found)), n_rows[m], keep[m], pick[m]) for m in grams
    }


def _settled(gram: np.ndarray, best: Profile, ratio: float, n_rows: int, keep: list[int], pick: tuple) -> Fit:
    p, q = len(gram) - 1, len(keep)
    criterion, coef, inverse, sigma2 = profile(best.cross[pick], best.log_det, n_rows, q)
    at_zero = profile(gram[pick], 0.0, n_rows, q)
    if at_zero[0] <= criterion:
        ratio, (criterion, coef, inverse, sigma2) = 0.0, at_zero
    full, cov = np.zeros(p), np.full((p, p), np.nan)
    full[keep] = coef
    cov[np.ix_(keep, keep)] = sigma2 * inverse
    return Fit(full, cov, sigma2, ratio, float(criterion))


@dataclass(frozen=True)
class SmoothFit:
    coef: np.ndarray
    covariance: np.ndarray
    sigma2: float
    user_ratio: float
    smooth_ratio: float
    criterion: float


class _Surface:
    """The criterion of a model with a random intercept and one penalised block, over both log variance ratios."""

    USER, SMOOTH = (-16.0, 12.0), (-18.0, 18.0)

    def __init__(self, moments: Moments, n_rows: int, fixed: int):
        self.moments, self.n_rows, self.fixed = moments, n_rows, fixed
        self.p = len(moments.gram) - 1
        self.wiggly = np.arange(fixed, self.p)

    def _solved(self, log_user: np.ndarray, log_smooth: np.ndarray):
        ratio = np.exp(log_user)[:, None]
        seen = 1.0 + self.moments.size * ratio
        cross = self.moments.gram - np.tensordot(ratio / seen, self.moments.between, 1)
        system = cross[:, : self.p, : self.p].copy()
        system[:, self.wiggly, self.wiggly] += np.exp(-log_smooth)[:, None]
        inverse = np.linalg.inv(system)
        coef = (inverse @ cross[:, : self.p, self.p :])[:, :, 0]
        rss = np.maximum(cross[:, self.p, self.p] - np.einsum("gi,gi->g", coef, cross[:, : self.p, self.p]), 1e-300)
        return ratio, seen, system, inverse, coef, rss

    def value(self, log_user: np.ndarray, log_smooth: np.ndarray) -> np.ndarray:
        _, seen, system, _, _, rss = self._solved(log_user, log_smooth)
        log_det = np.log(seen) @ self.moments.users + np.linalg.slogdet(system)[1]
        return (self.n_rows - self.fixed) * np.log(rss) + log_det + len(self.wiggly) * log_smooth

    def user_slope(self, log_user: np.ndarray, log_smooth: float) -> np.ndarray:
        ratio, seen, _, inverse, coef, rss = self._solved(log_user, np.full(len(log_user), log_smooth))
        slope = -np.tensordot(ratio / seen**2, self.moments.between, 1)
        residual = np.concatenate([-coef, np.ones((len(coef), 1))], axis=1)
        moved = np.einsum("gi,gij,gj->g", residual, slope, residual) * (self.n_rows - self.fixed) / rss
        own = (self.moments.size * ratio / seen) @ self.moments.users
        return moved + own + np.einsum("gij,gij->g", inverse, slope[:, : self.p, : self.p])

    def smooth_slope(self, log_user: float, log_smooth: float) -> float:
        _, _, _, inverse, coef, rss = self._solved(np.array([log_user]), np.array([log_smooth]))
        w = self.wiggly
        bent = (self.n_rows - self.fixed) * (coef[0, w] ** 2).sum() / rss[0] + inverse[0, w, w].sum()
        return float(len(w) - bent * np.exp(-log_smooth))

    def best_user(self, log_smooth: float, low: float, high: float) -> float:
        """The root of the slope in the user ratio, or the end of the interval that it points to."""
        for _ in range(12):
            grid = np.linspace(low, high, 17)
            slopes = self.user_slope(grid, log_smooth)
            rising = np.flatnonzero(slopes > 0)
            if not len(rising):
                return high
            at = int(rising[0])
            if at == 0:
                return low
            low, high = float(grid[at - 1]), float(grid[at])
        return (low + high) / 2

    def best(self, user: tuple[float, float], smooth: tuple[float, float]) -> tuple[float, float]:
        """Both ratios: bisection of the slope in the smooth ratio, with the user ratio at its best for each."""
        low, high = smooth
        for _ in range(54):
            middle = (low + high) / 2
            if self.smooth_slope(self.best_user(middle, *user), middle) > 0:
                high = middle
            else:
                low = middle
        log_smooth = (low + high) / 2
        return self.best_user(log_smooth, *user), log_smooth


def fit_smooth(moments: Moments, n_rows: int, fixed: int) -> SmoothFit:
    """Random intercept plus one penalised block: columns are ``fixed`` terms, then the block, then y.

    A coarse grid over both ratios shows whether the root that was found is the least point; if not, the search is
    done again around the grid's best point.
    """
    surface = _Surface(moments, n_rows, fixed)
    if len(surface.wiggly):
        log_user, log_smooth = surface.best(surface.USER, surface.SMOOTH)
        a, b = np.linspace(*surface.USER, 15), np.linspace(*surface.SMOOTH, 19)
        points = np.array([(x, y) for x in a for y in b])
        values = surface.value(points[:, 0], points[:, 1])
        i = int(np.nanargmin(values))
        if values[i] < surface.value(np.array([log_user]), np.array([log_smooth]))[0] - 1e-6:
            near = [(max(e[0], x - 2), min(e[1], x + 2)) for e, x in zip((surface.USER, surface.SMOOTH), points[i])]
            log_user, log_smooth = surface.best(*near)
    else:
        log_user, log_smooth = surface.best_user(0.0, *surface.USER), 0.0
    at = np.array([log_user]), np.array([log_smooth])
    _, _, _, inverse, coef, rss = surface._solved(*at)
    sigma2 = float(rss[0]) / (n_rows - fixed)
    return SmoothFit(
        coef[0], sigma2 * inverse[0], sigma2, float(np.exp(log_user)), float(np.exp(log_smooth)), float(surface.value(*at)[0])
    )
