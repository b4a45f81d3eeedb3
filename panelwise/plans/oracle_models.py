"""The fitted models once more in SQL: sums, a search by bisection and elimination, and everything that rests on them.

The search is a recursive query. A row holds a model's bracket of the log variance ratio and its matrix of weighted cross
products; each step eliminates one column, and after the last one the sign of the derivative halves the bracket.
"""

from __future__ import annotations

from panelwise.operators.smooth import range_design
from panelwise.plans.oracle_views import VIEWS

CHANNELS = ["steps", "heart", "sleep"]
STATE = {"steps": "state__steps__scale1k", "heart": "state__heart", "sleep": "state__sleep__scale60"}
MODELS = [f"{c}{suffix}" for suffix in ("", "_bl") for c in CHANNELS]
MODEL_ROWS = "model_rows AS (" + " UNION ALL ".join(
    f"SELECT '{c}{suffix}' AS model, user_id, day_of_week, week_L, week_Q, week_C, {STATE[c]} AS state, "
    f"{c}__observed AS y FROM activity_panel WHERE {c}__observed IS NOT NULL AND {STATE[c]} IS NOT NULL{extra}"
    for suffix, extra in (("", ""), ("_bl", " AND flu_period = 'baseline'"))
    for c in CHANNELS
) + ")"
LATER_WEEKDAYS = ["Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]
MODEL_COLUMNS = ["week_L", "week_Q", "week_C", "state", "y"]
CENTRED = (
    "centred AS (SELECT model, user_id, day_of_week, "
    + ", ".join(f"{c} - avg({c}) OVER m AS x{i}" for i, c in enumerate(MODEL_COLUMNS))
    + " FROM model_rows WINDOW m AS (PARTITION BY model))"
)
USER_CENTRED = (
    "user_centred AS (SELECT model, user_id, count(*) AS n, count(*)::DOUBLE AS c0, "
    + ", ".join(f"sum(x{i}) AS c{i + 1}" for i in range(4))
    + ", "
    + ", ".join(
        f"count(CASE WHEN day_of_week = '{w}' THEN 1 END)::DOUBLE AS c{5 + k}" for k, w in enumerate(LATER_WEEKDAYS)
    )
    + ", sum(x4) AS c11 FROM centred GROUP BY 1, 2)"
)
#: Columns of the design (intercept, four numeric terms, six weekdays), and with the outcome.
P, WIDTH = 11, 12


def _square(cell) -> str:
    return "[" + ", ".join("[" + ", ".join(cell(i, j) for j in range(WIDTH)) + "]" for i in range(WIDTH)) + "]"


def cells(body: str, width: int) -> str:
    """A matrix whose cell (i, j) is ``body``."""
    return (
        f"list_transform(range(1, {width + 1}), lambda i: list_transform(range(1, {width + 1}), lambda j: {body}))"
    )


def total(body: str, width: int) -> str:
    """The sum of ``body`` over all cells (i, j)."""
    return (
        f"list_sum(list_transform(range(1, {width + 1}), lambda i: "
        f"list_sum(list_transform(range(1, {width + 1}), lambda j: {body}))))"
    )


def eliminated(pivot: str, width: int, m: str = "m") -> str:
    """``m`` after elimination of one column; after all of them it holds the inverse, the coefficients and the rest."""
    at = f"{m}[{pivot}][{pivot}]"
    return cells(
        f"CASE WHEN i = {pivot} AND j = {pivot} THEN 1 / {at} WHEN i = {pivot} THEN {m}[i][j] / {at} "
        f"WHEN j = {pivot} THEN -{m}[i][j] / {at} ELSE {m}[i][j] - {m}[i][{pivot}] * {m}[{pivot}][j] / {at} END",
        width,
    )


def _weighted(ratio: str) -> str:
    return cells(
        f"gram[i][j] - list_sum(list_transform(sizes, lambda s: {ratio} / (1 + s.n * {ratio}) * s.b[i][j]))", WIDTH
    )


_DUMMY = [f"(day_of_week = '{w}')::INTEGER::DOUBLE" for w in LATER_WEEKDAYS]
_Z = ["1.0::DOUBLE", "x0", "x1", "x2", "x3", *_DUMMY, "x4"]
GRAMS = (
    "design AS (SELECT model, " + ", ".join(f"{z} AS z{i}" for i, z in enumerate(_Z)) + " FROM centred),\n"
    "grams AS (SELECT model, count(*) AS n_rows, " + _square(lambda i, j: f"sum(z{i} * z{j})") + " AS gram "
    "FROM design GROUP BY 1),\n"
    "by_size AS (SELECT model, n, count(*) AS users, " + _square(lambda i, j: f"sum(c{i} * c{j})") + " AS b "
    "FROM user_centred GROUP BY 1, 2),\n"
    "stats AS MATERIALIZED (SELECT model, gram, n_rows, (SELECT list({'n': n, 'users': users, 'b': b} ORDER BY n) "
    "FROM by_size s WHERE s.model = g.model) AS sizes FROM grams g)"
)
_STEPS = 60
_RESIDUAL = f"list_append(list_transform(range(1, {P + 1}), lambda i: -m[i][{WIDTH}]), 1.0::DOUBLE)"
_SLOPE = f"""list_sum(list_transform(sizes, lambda s:
      s.users * s.n * ratio / (1 + s.n * ratio) - ratio / (1 + s.n * ratio) ** 2 * (
        {total('r[i] * r[j] * s.b[i][j]', WIDTH)} * (n_rows - {P}) / m[{WIDTH}][{WIDTH}]
        + {total('m[i][j] * s.b[i][j]', P)})))"""
SEARCH = f"""search AS (
  SELECT model, 0 AS step, 0 AS k, -16.0::DOUBLE AS lo, 12.0::DOUBLE AS hi, -16.0::DOUBLE AS log_ratio,
    exp(-16.0::DOUBLE) AS ratio, {_weighted('exp(-16.0::DOUBLE)')} AS m, 0.0::DOUBLE AS log_det
  FROM stats
  UNION ALL
  SELECT model, step, k, lo, hi, log_ratio, ratio,
    CASE WHEN k = 0 THEN {_weighted('ratio')} ELSE {eliminated('k', WIDTH)} END,
    CASE WHEN k = 0 THEN 0.0 ELSE log_det + ln(m[k][k]) END
  FROM (
    SELECT model, step, k, lo, hi, log_ratio, m, log_det, gram, sizes,
      CASE WHEN step > 0 AND log_ratio <= -16 THEN 0.0 ELSE exp(log_ratio) END AS ratio
    FROM (
      SELECT model, gram, sizes, m, log_det, lo, hi, CASE WHEN k = {P} THEN step + 1 ELSE step END AS step,
        CASE WHEN k = {P} THEN 0 ELSE k + 1 END AS k,
        CASE WHEN k = {P} THEN (lo + hi) / 2 ELSE log_ratio END AS log_ratio
      FROM (
        SELECT model, gram, sizes, m, log_det, step, k, log_ratio,
          CASE WHEN k = {P} AND step > 0 AND slope <= 0 THEN log_ratio ELSE lo END AS lo,
          CASE WHEN k = {P} AND step = 0 AND slope >= 0 THEN lo WHEN k = {P} AND step > 0 AND slope > 0 THEN log_ratio
            ELSE hi END AS hi
        FROM (
          SELECT *, CASE WHEN k = {P} THEN {_SLOPE} END AS slope
          FROM (SELECT s.*, t.gram, t.sizes, t.n_rows, CASE WHEN k = {P} THEN {_RESIDUAL} END AS r
                FROM search s JOIN stats t USING (model) WHERE step < {_STEPS} OR k < {P})))))),
means AS (SELECT model, {', '.join(f'avg({c}) AS mean_{c}' for c in MODEL_COLUMNS)} FROM model_rows GROUP BY 1),
fits AS MATERIALIZED (
  SELECT model, ratio, t.n_rows, (SELECT count(*) FROM user_centred u WHERE u.model = s.model) AS n_users,
    m[{WIDTH}][{WIDTH}] / (t.n_rows - {P}) AS sigma2, list_transform(range(1, {P + 1}), lambda i: m[i][{WIDTH}]) AS beta, m,
    (t.n_rows - {P}) * ln(m[{WIDTH}][{WIDTH}]) + log_det
      + list_sum(list_transform(sizes, lambda z: z.users * ln(1 + z.n * ratio))) AS criterion,
    [1.0::DOUBLE, -mean_week_L, -mean_week_Q, -mean_week_C, -mean_state] AS back,
    m[1][{WIDTH}] + mean_y - m[2][{WIDTH}] * mean_week_L - m[3][{WIDTH}] * mean_week_Q - m[4][{WIDTH}] * mean_week_C
      - m[5][{WIDTH}] * mean_state AS intercept
  FROM search s JOIN stats t USING (model) JOIN means USING (model) WHERE step = {_STEPS} AND k = {P})"""
_EXPECTED = " + ".join(f"beta[{j + 1}] * c{j}" for j in range(P))
EFFECTS = (
    f"effects AS (SELECT model, user_id, ratio / (1 + n * ratio) * (c11 - ({_EXPECTED})) AS effect "
    "FROM user_centred JOIN fits USING (model))"
)


def _fixed(model: str) -> str:
    f, state = f"f_{model}", STATE[model.split("_")[0]]
    days = " ".join(f"WHEN '{w}' THEN {f}.beta[{6 + k}]" for k, w in enumerate(LATER_WEEKDAYS))
    return (
        f"{f}.intercept + {f}.beta[2] * week_L + {f}.beta[3] * week_Q + {f}.beta[4] * week_C + {f}.beta[5] * {state} "
        f"+ CASE day_of_week {days} ELSE 0.0 END + coalesce(e_{model}.effect, 0.0)"
    )


PREDICTED = (
    "predicted AS MATERIALIZED (SELECT p.*, "
    + ", ".join(f"{_fixed(m)} AS {m}__predicted" for m in MODELS)
    + " FROM activity_panel p "
    + " ".join(
        f"CROSS JOIN (SELECT * FROM fits WHERE model = '{m}') f_{m} "
        f"LEFT JOIN (SELECT * FROM effects WHERE model = '{m}') e_{m} ON e_{m}.user_id = p.user_id"
        for m in MODELS
    )
    + ")"
)
OUTPUTS = (
    "outputs AS MATERIALIZED (SELECT *, "
    + ", ".join(
        f"CASE WHEN valid_user__{c} = 1 THEN coalesce({c}__observed, {c}__predicted) END AS {c}__imputed, "
        f"CASE WHEN valid_user__{c} = 1 AND (valid_day__{c} <> 1 OR {c}__observed IS NULL) THEN 1 ELSE 0 END "
        f"AS {c}__was_imputed, {c}__observed - {c}__predicted AS {c}__resids, "
        f"{c}__observed - {c}_bl__predicted AS {c}__bl_resids"
        for c in CHANNELS
    )
    + " FROM predicted)"
)
EXCESS = (
    "excess AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS channel, cohort, user_id, days_since_onset, {c}__bl_resids AS excess FROM outputs "
        f"WHERE valid_user__{c} = 1 AND valid_day__{c} = 1"
        for c in ("steps", "sleep")
    )
    + ")"
)

# --- smooth curves: the basis of the days -10 to 20 is a literal, both ratios are found by nested bisection

_DESIGN = range_design(-10, 20)
_Q = _DESIGN.shape[1]
_BASIS = "[" + ", ".join("[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in row) + "]" for row in _DESIGN) + "]"
_INNER, _OUTER = 44, 46


def _sums(cell) -> str:
    return "[" + ", ".join("[" + ", ".join(cell(i, j) for j in range(_Q + 1)) + "]" for i in range(_Q + 1)) + "]"


_SYSTEM = cells(
    "gram[i][j] - list_sum(list_transform(sizes, lambda s: a / (1 + s.n * a) * s.b[i][j])) "
    f"+ CASE WHEN i = j AND i > 2 AND i <= {_Q} THEN exp(-log_smooth) ELSE 0.0 END",
    _Q + 1,
)
# a list of the matrix and as many empty ones as there are columns: folding it eliminates column k - 1 at the k-th
_SOLVED = (
    f"list_reduce(list_concat([{_SYSTEM}], list_transform(range(1, {_Q + 1}), lambda x: CAST(NULL AS DOUBLE[][]))), "
    f"lambda acc, x, k: {eliminated('(k - 1)', _Q + 1, 'acc')})"
)
_SMOOTH_RESIDUAL = f"list_append(list_transform(range(1, {_Q + 1}), lambda i: -m[i][{_Q + 1}]), 1.0::DOUBLE)"
_USER_SLOPE = f"""list_sum(list_transform(sizes, lambda s:
      s.users * s.n * a / (1 + s.n * a) - a / (1 + s.n * a) ** 2 * (
        {total('r[i] * r[j] * s.b[i][j]', _Q + 1)} * (n_rows - 2) / m[{_Q + 1}][{_Q + 1}]
        + {total('m[i][j] * s.b[i][j]', _Q)})))"""
_SMOOTH_SLOPE = (
    f"({_Q - 2} - exp(-log_smooth) * list_sum(list_transform(range(3, {_Q + 1}), lambda i: "
    f"(n_rows - 2) * m[i][{_Q + 1}] ** 2 / m[{_Q + 1}][{_Q + 1}] + m[i][i])))"
)
SMOOTH = f"""near AS MATERIALIZED (
  SELECT channel, cohort, user_id, days_since_onset AS day, excess, avg(excess) OVER (PARTITION BY channel, cohort) AS shift
  FROM excess WHERE days_since_onset BETWEEN -10 AND 20 AND excess IS NOT NULL),
placed AS (
  SELECT channel, cohort, user_id, list_append({_BASIS}[day + 11], excess - shift) AS z FROM near),
curve_grams AS (
  SELECT channel, cohort, count(*) AS n_rows, count(DISTINCT user_id) AS n_users,
    {_sums(lambda i, j: f'sum(z[{i + 1}] * z[{j + 1}])')} AS gram FROM placed GROUP BY 1, 2),
curve_users AS (
  SELECT channel, cohort, user_id, count(*) AS n, {', '.join(f'sum(z[{i + 1}]) AS c{i}' for i in range(_Q + 1))}
  FROM placed GROUP BY 1, 2, 3),
curve_sizes AS (
  SELECT channel, cohort, n, count(*) AS users, {_sums(lambda i, j: f'sum(c{i} * c{j})')} AS b
  FROM curve_users GROUP BY 1, 2, 3),
curve_stats AS MATERIALIZED (
  SELECT channel, cohort, n_rows, n_users, gram, (SELECT list({{'n': n, 'users': users, 'b': b}} ORDER BY n)
    FROM curve_sizes s WHERE s.channel = g.channel AND s.cohort = g.cohort) AS sizes FROM curve_grams g),
curve_search AS (
  SELECT channel, cohort, 0 AS outer_step, 0 AS inner_step, -18.0::DOUBLE AS low_smooth, 18.0::DOUBLE AS high_smooth,
    0.0::DOUBLE AS log_smooth, -16.0::DOUBLE AS low, 12.0::DOUBLE AS high, -2.0::DOUBLE AS log_user,
    CAST(NULL AS DOUBLE[][]) AS m, CAST(NULL AS DOUBLE) AS a
  FROM curve_stats
  UNION ALL
  SELECT channel, cohort, CASE WHEN done THEN outer_step + 1 ELSE outer_step END, CASE WHEN done THEN 0 ELSE inner_step + 1 END,
    new_low, new_high, CASE WHEN done THEN (new_low + new_high) / 2 ELSE log_smooth END,
    CASE WHEN done THEN -16.0 WHEN user_slope > 0 THEN low ELSE log_user END,
    CASE WHEN done THEN 12.0 WHEN user_slope > 0 THEN log_user ELSE high END,
    CASE WHEN done THEN -2.0 WHEN user_slope > 0 THEN (low + log_user) / 2 ELSE (log_user + high) / 2 END, m, a
  FROM (
    SELECT *, CASE WHEN done AND {_SMOOTH_SLOPE} <= 0 THEN log_smooth ELSE low_smooth END AS new_low,
      CASE WHEN done AND {_SMOOTH_SLOPE} > 0 THEN log_smooth ELSE high_smooth END AS new_high,
      CASE WHEN NOT done THEN {_USER_SLOPE} END AS user_slope
    FROM (
      SELECT *, inner_step = {_INNER} AS done, CASE WHEN inner_step < {_INNER} THEN {_SMOOTH_RESIDUAL} END AS r
      FROM (
        SELECT * REPLACE ({_SOLVED} AS m)
        FROM (
          SELECT s.* REPLACE (exp(s.log_user) AS a), t.gram, t.sizes, t.n_rows
          FROM curve_search s JOIN curve_stats t USING (channel, cohort)
          WHERE outer_step < {_OUTER} OR inner_step < {_INNER}))))),
curve_fits AS MATERIALIZED (
  SELECT channel, cohort, n_rows, n_users, sizes, a, s, m, m[{_Q + 1}][{_Q + 1}] / (n_rows - 2) AS sigma2
  FROM (
    SELECT * REPLACE ({_SOLVED} AS m), exp(log_smooth) AS s
    FROM (SELECT c.* REPLACE (exp(c.log_user) AS a), t.gram, t.sizes, t.n_rows, t.n_users FROM curve_search c
          JOIN curve_stats t USING (channel, cohort) WHERE outer_step = {_OUTER} AND inner_step = {_INNER})))"""
_AT = f"{_BASIS}[day + 11]"
CURVES = f"""fitted AS (
  SELECT f.channel, f.cohort, day, mean_y,
    shift + list_sum(list_transform(range(1, {_Q + 1}), lambda i: z[i] * m[i][{_Q + 1}])) AS fit,
    sqrt(sigma2 * {total('z[i] * z[j] * m[i][j]', _Q)}) AS se
  FROM (SELECT channel, cohort, day, {_AT} AS z, avg(excess) AS mean_y, any_value(shift) AS shift FROM near GROUP BY 1, 2, 3) d
  JOIN curve_fits f ON f.channel = d.channel AND f.cohort = d.cohort)"""
FIT_STEPS = [MODEL_ROWS, CENTRED, USER_CENTRED, GRAMS, SEARCH]
OUTPUT_STEPS = [*FIT_STEPS, EFFECTS, PREDICTED, OUTPUTS]


def recursive(*steps_and_query: str) -> str:
    """As ``with_views``, with steps that may be recursive."""
    *steps, query = steps_and_query
    return "WITH RECURSIVE " + ",\n".join([VIEWS.strip(), *steps]) + "\n" + query


def _round(value: str, places: int = 4) -> str:
    return f"(round({value}, {places}) + 0.0)"


def binary(value: str) -> str:
    return f"(round(({value}) * 8192) / 8192 + 0.0)"


_TERMS = ["(Intercept)", "week_L", "week_Q", "week_C", None, *[f"day_of_week{w}" for w in LATER_WEEKDAYS]]


def _coefficients() -> str:
    rows = []
    for k, term in enumerate(_TERMS):
        name = f"'{term}'" if term else (
            "CASE split_part(model, '_', 1) " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in STATE.items()) + " END"
        )
        estimate = "intercept" if k == 0 else f"beta[{k + 1}]"
        spread = total("back[i] * back[j] * m[i][j]", 5) if k == 0 else f"m[{k + 1}][{k + 1}]"
        rows.append(f"SELECT model, {name} AS term, {estimate} AS b, sqrt(sigma2 * {spread}) AS se FROM fits")
    return "coefficients AS (" + " UNION ALL ".join(rows) + ")"


def _scores(kind: str) -> str:
    return ", ".join(
        _round(f"({c}__{kind} - avg({c}__{kind}) OVER w) / nullif(stddev_samp({c}__{kind}) OVER w, 0)") + f" AS {c}__{kind}_z"
        for c in CHANNELS
    )


def model_oracle(elevated: str, elevated_query: str) -> dict[str, str]:
    """The oracle entries that rest on fitted models; the elevated-rate steps come from the caller."""
    return {
        "lmm_fit": recursive(
            *FIT_STEPS, _coefficients(),
            f"SELECT model, term, {_round('b')} AS estimate, {_round('se')} AS std_error, {_round('b / se')} AS t_value, "
            f"n_rows, n_users, {_round('sigma2')} AS residual_variance, {_round('sigma2 * ratio')} AS user_variance, "
            f"{_round('criterion')} AS criterion FROM coefficients JOIN fits USING (model)",
        ),
        "lmm_predict": recursive(
            *FIT_STEPS, EFFECTS, PREDICTED,
            "SELECT user_id, study_date, "
            + ", ".join(f"{binary(f'{m}__predicted')} AS {m}__predicted" for m in MODELS) + " FROM predicted",
        ),
        "impute_values": recursive(
            *OUTPUT_STEPS,
            "SELECT user_id, study_date, "
            + ", ".join(f"{binary(f'{c}__imputed')} AS {c}__imputed, {c}__was_imputed" for c in CHANNELS) + " FROM outputs",
        ),
        "residuals": recursive(
            *OUTPUT_STEPS,
            "SELECT user_id, study_date, "
            + ", ".join(f"{binary(c + k)} AS {c}{k}" for c in CHANNELS for k in ("__resids", "__bl_resids")) + " FROM outputs",
        ),
        "zscore_imputed": recursive(
            *OUTPUT_STEPS,
            f"SELECT user_id, study_date, {_scores('imputed')} FROM outputs WINDOW w AS (PARTITION BY user_id)",
        ),
        "elevated_rate_imputed": recursive(*OUTPUT_STEPS, elevated, elevated_query),
        "excess_by_day": recursive(
            *OUTPUT_STEPS,
            EXCESS,
            f"SELECT channel, cohort, days_since_onset, {_round('avg(excess)')} AS mean_excess, count(excess) AS n_days "
            "FROM excess WHERE days_since_onset BETWEEN -10 AND 20 GROUP BY 1, 2, 3",
        ),
        "smooth_curve": recursive(
            *OUTPUT_STEPS, EXCESS, SMOOTH, CURVES,
            f"SELECT channel, cohort, day AS days_since_onset, {_round('mean_y')} AS mean_y, {_round('fit')} AS fit, "
            f"{_round('se')} AS se, {_round('fit - se')} AS low, {_round('fit + se')} AS high FROM fitted",
        ),
        "smooth_fit": recursive(
            *OUTPUT_STEPS, EXCESS, SMOOTH,
            f"SELECT channel, cohort, n_rows, n_users, {_round('sigma2')} AS residual_variance, "
            f"{_round('sigma2 * a')} AS user_variance, {_round('sigma2 * s')} AS smooth_variance, "
            + _round(f"{_Q - 1} - list_sum(list_transform(range(3, {_Q + 1}), lambda i: m[i][i])) / s") + " AS edf_curve, "
            + _round(
                "n_users - list_sum(list_transform(sizes, lambda z: z.users / (1 + z.n * a) "
                f"+ a / (1 + z.n * a) ** 2 * {total('m[i][j] * z.b[i][j]', _Q)}))"
            )
            + " AS edf_users FROM curve_fits",
        ),
        "lmm_levels": recursive(
            MODEL_ROWS.replace("day_of_week, week_L", "day_of_week, cohort || ' in ' || flu_period AS setting, week_L"),
            "counted AS (SELECT model, day_of_week AS level, count(*) AS n FROM model_rows GROUP BY 1, 2 "
            "UNION ALL SELECT model || ' by setting', setting, count(*) FROM model_rows GROUP BY 1, 2)",
            "SELECT model, level, n, CAST(row_number() OVER (PARTITION BY model ORDER BY level) - 1 AS INTEGER) AS position "
            "FROM counted",
        ),
    }
