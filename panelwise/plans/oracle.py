"""Oracle SQL: every registered query with a relational answer, written independently of the operators.

Rank tests compare pairs, medians use the built-in, and tables are filled cell by cell: the SQL is the plain
statement of each result, not of how Spark gets there. Fitted models are in ``oracle_models``.
"""

from __future__ import annotations

from panelwise.plans.oracle_models import CENTRED, LATER_WEEKDAYS, MODEL_ROWS, STATE, USER_CENTRED, binary, model_oracle
from panelwise.plans.oracle_views import with_views

COHORTS = ["alpha", "beta", "gamma"]
ALL = [f"All {c}" for c in COHORTS]
DENSE = [f"Dense {c}" for c in COHORTS]
CHANNELS = ["steps", "heart", "sleep"]
KINDS = ["economy", "large", "medium", "promo", "small", "standard"]
SYMPTOMS = [f"symptoms__{k}" for k in KINDS]
ITEMS = [f"daily_symp__{i}" for i in ["click", "error", "purchase", "signup", "view", "never"]]
PAIRS = [("All alpha", "All beta"), ("All alpha", "All gamma"), ("All beta", "All gamma")]


def _round(value: str, places: int = 6) -> str:
    return f"(round({value}, {places}) + 0.0)"


def _list(names: list[str]) -> str:
    return ", ".join(names)


def _erfc(x: str) -> str:
    """erfc(x) for x >= 0 to about 15 places: the all-positive series of erf."""
    terms = f"list_transform(range(0, 140), lambda i: exp((2 * i + 1) * ln({x}) - lgamma(i + 1.5) - {x} * {x}))"
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 1e-12 THEN 1.0 WHEN {x} > 6 THEN 0.0 ELSE 1.0 - list_sum({terms}) END)"


def _two_sided(z: str) -> str:
    return _erfc(f"(abs({z}) / sqrt(2.0))")


def _chi_upper(x: str, k: str) -> str:
    half = f"(({x}) / 2.0)"
    terms = (
        f"list_transform(range(0, CAST({k} // 2 AS BIGINT)), lambda i: "
        f"exp(-{half} + (i + ({k} % 2) / 2.0) * ln({half}) - lgamma(i + ({k} % 2) / 2.0 + 1)))"
    )
    odd = f"CASE WHEN {k} % 2 = 1 THEN {_erfc(f'sqrt({half})')} ELSE 0.0 END"
    return f"(CASE WHEN {x} <= 0 THEN 1.0 ELSE coalesce(list_sum({terms}), 0.0) + {odd} END)"


def _title(text: str) -> str:
    return (
        f"list_aggregate(list_transform(regexp_extract_all({text}, '[A-Za-z]+|[^A-Za-z]+'), "
        "lambda s: upper(s[1:1]) || lower(s[2:])), 'string_agg', '')"
    )


DEMOGRAPHIC_ANSWERS = "answers AS (" + " UNION ALL ".join(
    f"SELECT user_id, '{q}' AS variable, coalesce({_title(q)}, 'Unavailable') AS value FROM participants"
    for q in ["area", "segment", "priority", "balance_group"]
) + ")"
CARE = """care AS (
  SELECT *, CASE WHEN contains(care_where, '__') THEN 'multiple' WHEN care_where IN ('a', 'n', 'unavailable')
    THEN care_where ELSE 'other' END AS care_cleaned FROM survey)"""
CARE_ANSWERS = """answers AS (
  SELECT user_id, 'care_cleaned' AS variable, coalesce(care_cleaned, 'unavailable') AS value FROM care
  UNION ALL SELECT user_id, 'hospitalized', coalesce(hospitalized, 'unavailable') FROM care)"""
SYMPTOM_ANSWERS = "answers AS (" + " UNION ALL ".join(
    f"SELECT user_id, '{s}' AS variable, coalesce({s}, '') AS value FROM survey" for s in SYMPTOMS
) + ")"
FULL = "sets AS (SELECT * FROM membership WHERE cohort_label LIKE 'All%')"
EVERY = "sets AS (SELECT * FROM membership)"
ACTIVITY = "sets AS (SELECT * FROM activity_sets)"
COUNTED = """counted AS (
  SELECT cohort_label, variable, value, count(*) AS n FROM answers JOIN sets USING (user_id) GROUP BY ALL),
shares AS (
  SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY cohort_label, variable) AS percent FROM counted)"""


def _percent_cells(labels: list[str]) -> str:
    return ", ".join(
        f"coalesce(max(CASE WHEN cohort_label = '{c}' THEN CAST(round_even(percent, 1) AS VARCHAR) || '%' END), '0.0%')"
        f' AS "{c}"'
        for c in labels
    )


CHI_CELLS = """grid_cells AS (
  SELECT r.variable, r.value, c.cohort_label, coalesce(k.n, 0) AS o
  FROM (SELECT DISTINCT variable, value FROM counted) r
  JOIN (SELECT DISTINCT variable, cohort_label FROM counted) c USING (variable)
  LEFT JOIN counted k ON k.variable = r.variable AND k.value = r.value AND k.cohort_label = c.cohort_label),
expected AS (
  SELECT *, sum(o) OVER (PARTITION BY variable, value) * 1.0 * sum(o) OVER (PARTITION BY variable, cohort_label)
    / sum(o) OVER (PARTITION BY variable) AS e FROM grid_cells),
tested AS (
  SELECT variable, CAST(sum(o) AS BIGINT) AS n_total,
    CAST((count(DISTINCT value) - 1) * (count(DISTINCT cohort_label) - 1) AS INTEGER) AS dof,
    CASE WHEN (count(DISTINCT value) - 1) * (count(DISTINCT cohort_label) - 1) = 1
      THEN sum(greatest(abs(o - e) - 0.5, 0) ** 2 / e) ELSE sum((o - e) ** 2 / e) END AS chi2
  FROM expected GROUP BY variable),
scored AS (SELECT *, """ + _chi_upper("chi2", "dof") + """ AS p, 0.05 / (SELECT count(*) FROM tested) AS t FROM tested)"""
CHI_RESULT = f"""SELECT variable, n_total, dof, {_round('chi2')} AS chi2, {_round('p')} AS p_value,
  {_round('t')} AS threshold, p < t AS significant FROM scored"""


def _z_steps(pairs: list[tuple[str, str]]) -> list[str]:
    listed = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return [
        f"pairs AS (SELECT * FROM (VALUES {listed}) AS t(cohort1, cohort2))",
        """flagged AS (
  SELECT p.cohort1, p.cohort2, a.variable, a.value,
    CASE WHEN EXISTS (SELECT 1 FROM sets s WHERE s.user_id = a.user_id AND s.cohort_label = p.cohort1)
      THEN 1 ELSE 0 END AS in1,
    CASE WHEN EXISTS (SELECT 1 FROM sets s WHERE s.user_id = a.user_id AND s.cohort_label = p.cohort2)
      THEN 1 ELSE 0 END AS in2
  FROM answers a CROSS JOIN pairs p),
z_counts AS (
  SELECT cohort1, cohort2, variable, value, sum(in1) AS k1, sum(in2) AS k2, sum(greatest(in1, in2)) AS ku
  FROM flagged GROUP BY ALL),
z_shares AS (
  SELECT cohort1, cohort2, variable, value,
    coalesce(k1 / nullif(sum(k1) OVER w, 0), 0) AS p1, coalesce(k2 / nullif(sum(k2) OVER w, 0), 0) AS p2,
    coalesce(ku / nullif(sum(ku) OVER w, 0), 0) AS p_all
  FROM z_counts WINDOW w AS (PARTITION BY cohort1, cohort2, variable)),
z_scored AS (
  SELECT *, (p1 - p2) / nullif(sqrt(p_all * (1 - p_all) * (
      1.0 / (SELECT count(DISTINCT user_id) FROM sets WHERE cohort_label = cohort1)
      + 1.0 / (SELECT count(DISTINCT user_id) FROM sets WHERE cohort_label = cohort2))), 0) AS z FROM z_shares)""",
    ]


Z_RESULT = f"""SELECT cohort1, cohort2, variable, value, {_round('p1')} AS p1, {_round('p2')} AS p2,
  {_round('p_all')} AS p_all, {_round('z')} AS z, {_round(_two_sided('z'))} AS p_value FROM z_scored"""

DAILY = "daily_long AS (" + " UNION ALL ".join(
    f"SELECT cohort, days_since_onset, '{i}' AS variable, {i} AS report FROM daily_symptoms" for i in ITEMS
) + """),
daily_totals AS (
  SELECT cohort, days_since_onset, variable, coalesce(sum(report), 0) AS total,
    100 * avg(coalesce(report, 0)) AS percent
  FROM daily_long GROUP BY ALL)"""


def _peaks(before: int, after: int) -> str:
    size = before + after + 1
    return f"""rolled AS (
  SELECT *, CASE WHEN count(total) OVER w = {size} THEN avg(total) OVER w END AS smooth FROM daily_totals
  WINDOW w AS (PARTITION BY cohort, variable ORDER BY days_since_onset
    ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)),
peaks AS (
  SELECT cohort, variable, CASE WHEN smooth > 0 THEN days_since_onset END AS peak_day FROM rolled
  QUALIFY row_number() OVER (PARTITION BY cohort, variable ORDER BY smooth DESC NULLS LAST, days_since_onset) = 1)"""


PANEL_ORDER = """panel_order AS (
  SELECT variable, peak_day, CAST(row_number() OVER (ORDER BY peak_day ASC NULLS LAST, variable) AS INTEGER) AS position
  FROM peaks WHERE cohort = 'alpha')"""
PRESENT = "present AS (" + " UNION ALL ".join(
    f"SELECT user_id, cohort, '{k}' AS symptom FROM survey WHERE symptoms__{k} IS NOT NULL AND cohort IN ('alpha', 'beta')"
    for k in KINDS
) + """),
symptom_counts AS (
  SELECT symptom, count(CASE WHEN cohort = 'alpha' THEN 1 END) AS alpha,
    count(CASE WHEN cohort = 'beta' THEN 1 END) AS beta FROM present GROUP BY 1),
top AS (
  (SELECT symptom FROM symptom_counts ORDER BY alpha DESC, symptom LIMIT 3)
  UNION (SELECT symptom FROM symptom_counts ORDER BY beta DESC, symptom LIMIT 3))"""
DURATION = """ill AS (
  SELECT cohort, date_diff('day', date_onset, date_recovery) AS duration FROM survey WHERE date_recovery IS NOT NULL)"""
ELEVATED = """heart AS (
  SELECT user_id, cohort, days_since_onset,
    (heart__observed - avg(heart__observed) OVER w) / nullif(stddev_samp(heart__observed) OVER w, 0) AS z
  FROM activity_panel WHERE valid_user__heart = 1 WINDOW w AS (PARTITION BY user_id)),
rates AS (
  SELECT cohort, days_since_onset, threshold, avg(CASE WHEN z > threshold THEN 1.0 ELSE 0.0 END) AS raw_share
  FROM heart CROSS JOIN (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) AS t(threshold) GROUP BY ALL),
smoothed AS (
  SELECT *, CASE WHEN count(*) OVER w = 3 THEN avg(raw_share) OVER w END AS share FROM rates
  WINDOW w AS (PARTITION BY cohort, threshold ORDER BY days_since_onset ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
people AS (SELECT cohort, count(DISTINCT user_id) AS n_users FROM heart GROUP BY 1)"""
ELEVATED_RATES = (
    f"SELECT cohort, days_since_onset, threshold, n_users, {_round('share')} AS share, "
    f"{_round('sqrt(share * (1 - share) / n_users) / 2')} AS error_bar, "
    + _round(_two_sided("threshold") + " / 2")
    + " AS expected FROM smoothed JOIN people USING (cohort) WHERE days_since_onset BETWEEN -10 AND 20"
)
RANKS = """ranked_users AS (
  SELECT DISTINCT user_id, cohort, date_onset FROM activity_panel
  WHERE valid_user__steps = 1 OR valid_user__heart = 1 OR valid_user__sleep = 1),
date_ranks AS (
  SELECT *, CASE WHEN date_onset IS NOT NULL THEN row_number() OVER (ORDER BY date_onset NULLS LAST, user_id) END AS r
  FROM ranked_users),
shifted AS (
  SELECT user_id, r, CASE cohort WHEN 'alpha' THEN -(1000 + r) WHEN 'beta' THEN -(2000 + r) ELSE -r END AS moved
  FROM date_ranks),
ranks AS (
  SELECT user_id, CASE WHEN r IS NOT NULL THEN row_number() OVER (ORDER BY moved NULLS LAST, r) END AS user_rank
  FROM shifted)"""

RULES = " UNION ALL ".join(
    f"SELECT '{c}: {name}' AS rule, count(CASE WHEN {test} THEN 1 END) AS n_rows FROM unchecked_panel"
    for c in CHANNELS
    for name, test in (
        ("value of a non-valid user", f"valid_user__{c} = 0 AND {c}__observed IS NOT NULL"),
        ("value on a non-valid day", f"valid_day__{c} = 0 AND {c}__observed IS NOT NULL"),
        ("valid day without a value", f"valid_day__{c} = 1 AND {c}__observed IS NULL"),
    )
)
ANY_FLAGS = "coalesce(cond_a, false) OR coalesce(cond_b, false) OR coalesce(cond_ab, false)"
CONDITION_ROWS = "condition_rows AS (" + " UNION ALL ".join(
    f"SELECT cohort_label, '{name}' AS variable, '{label}' AS condition, coalesce({test}, false) AS has "
    "FROM participants JOIN membership USING (user_id) WHERE cohort_label LIKE 'All%'"
    for name, label, test in (
        ("cond_a", "Cond A", "cond_a"), ("cond_b", "Cond B", "cond_b"), ("cond_ab", "Cond Ab", "cond_ab"),
        ("cond_any", "Any Condition", f"({ANY_FLAGS})"),
    )
) + """),
condition_counts AS (
  SELECT cohort_label, variable, condition, count(CASE WHEN has THEN 1 END) AS n, count(*) AS n_group
  FROM condition_rows GROUP BY ALL)"""

ORACLE = {
    "scan_csv": with_views(
        "SELECT user_id, cohort, date_onset, date_recovery, care_where, hospitalized, symptoms__economy FROM survey"
    ),
    "scan_csv_by_name": with_views("SELECT user_id, cohort, date_onset, care_where, hospitalized FROM survey"),
    "preview": with_views(
        "(SELECT user_id, cohort, area, segment, 'head' AS part FROM participants ORDER BY user_id LIMIT 5) UNION ALL "
        "(SELECT user_id, cohort, area, segment, 'tail' FROM participants ORDER BY user_id DESC LIMIT 5)"
    ),
    "select_cols": with_views("SELECT user_id, cohort, area, segment, priority FROM participants"),
    "select_pattern": with_views(
        f"SELECT user_id, {_list([s for s in SYMPTOMS if s != 'symptoms__promo'])} FROM survey"
    ),
    "rename_map": with_views(f"SELECT user_id, {_list([f'symptoms__{k} AS {k}' for k in KINDS])} FROM survey"),
    "recode_labels": with_views(
        "SELECT user_id, CASE care_where WHEN 'a' THEN 'Place A' WHEN 'n' THEN 'Place N' ELSE care_where END AS care, "
        "CASE hospitalized WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No' ELSE hospitalized END AS hospitalized FROM survey"
    ),
    "filter_eq": with_views(
        "SELECT user_id, study_date, days_since_onset FROM activity_panel "
        "WHERE cohort = 'alpha' AND flu_period = 'baseline'"
    ),
    "filter_in": with_views(
        "SELECT user_id, cohort, care_where FROM survey "
        "WHERE cohort IN ('alpha', 'beta') AND care_where NOT IN ('a', 'n', 'unavailable')"
    ),
    "null_flags": with_views(
        f"SELECT user_id, cohort, {_list([f'{s} IS NOT NULL AS {s}' for s in SYMPTOMS])} FROM survey"
    ),
    "filter_range": with_views(
        "SELECT user_id, days_since_onset, valid_day__steps FROM activity_panel "
        "WHERE days_since_onset >= -10 AND days_since_onset <= 20"
    ),
    "filter_compare": with_views(
        f"SELECT user_id, study_date, {_round('steps__observed')} AS steps__observed FROM activity_panel "
        "WHERE steps__observed > 50"
    ),
    "filter_any_flag": with_views(
        "SELECT user_id, cohort, valid_user__steps, valid_user__heart, valid_user__sleep FROM participants "
        "WHERE valid_user__steps = 1 OR valid_user__heart = 1 OR valid_user__sleep = 1"
    ),
    "fill_nulls": with_views(
        "SELECT user_id, coalesce(segment, 'Unavailable') AS segment, coalesce(balance_group, 'Unavailable') AS "
        "balance_group, coalesce(cond_a, false) AS cond_a, coalesce(valid_user__steps, 0) AS valid_user__steps, "
        "coalesce(valid_user__heart, 0) AS valid_user__heart, coalesce(valid_user__sleep, 0) AS valid_user__sleep "
        "FROM participants"
    ),
    "dense_users": with_views(
        "SELECT user_id, coalesce(valid_user__steps, 0) + coalesce(valid_user__heart, 0) "
        "+ coalesce(valid_user__sleep, 0) AS n_streams FROM participants WHERE user_id IN (SELECT user_id FROM dense_users)"
    ),
    "care_location_clean": with_views(CARE, "SELECT care_cleaned, count(*) AS n FROM care GROUP BY 1"),
    "panel_consistency": with_views(RULES),
    "melt_long": with_views(
        " UNION ALL ".join(f"SELECT user_id, '{s}' AS variable, {s} AS value FROM survey" for s in SYMPTOMS)
    ),
    "split_name": with_views(
        " UNION ALL ".join(
            f"SELECT user_id, '{c}' AS channel, valid_user__{c} AS user_validity FROM participants" for c in CHANNELS
        )
    ),
    "pivot_cohort": with_views(
        "SELECT days_since_onset, "
        + _list([f"nullif(count(CASE WHEN cohort = '{c}' THEN 1 END), 0) AS {c}" for c in COHORTS])
        + " FROM activity_panel GROUP BY 1"
    ),
    "cohort_sizes": with_views("SELECT cohort_label, count(DISTINCT user_id) AS n_users FROM membership GROUP BY 1"),
    "semi_cohort": with_views(
        "SELECT user_id, cohort, care_where FROM survey "
        "WHERE user_id IN (SELECT user_id FROM membership WHERE cohort_label = 'Dense alpha')"
    ),
    "anti_cohort": with_views(
        "SELECT user_id, cohort FROM participants WHERE user_id NOT IN (SELECT user_id FROM dense_users)"
    ),
    "user_set_algebra": with_views(
        "two AS (SELECT user_id, user_id IN (SELECT user_id FROM dense_users) AS dense, cohort = 'alpha' AS alpha "
        "FROM participants)",
        "SELECT user_id, 'both' AS part FROM two WHERE dense AND alpha UNION ALL "
        "SELECT user_id, 'either' FROM two WHERE dense OR alpha UNION ALL "
        "SELECT user_id, 'dense only' FROM two WHERE dense AND NOT alpha",
    ),
    "distinct_users": with_views("SELECT DISTINCT user_id, cohort FROM activity_panel"),
    "summary_percent": with_views(
        DEMOGRAPHIC_ANSWERS, EVERY, COUNTED,
        f"SELECT variable, value, {_percent_cells(ALL + DENSE)} FROM shares GROUP BY 1, 2",
    ),
    "summary_ordered": with_views(
        DEMOGRAPHIC_ANSWERS, FULL, COUNTED,
        """placed AS (
  SELECT *, CASE value WHEN '4-Not Specified' THEN 'Not Specified' ELSE value END AS label FROM shares)""",
        f"""SELECT variable, label AS value, {_percent_cells(ALL)},
  CAST(list_position(['priority', 'area', 'segment'], variable) AS INTEGER) AS question_position,
  CAST(list_position(['Africa', 'America', 'Asia', 'Europe', 'Middle East', 'Building', 'Furniture', 'Household',
    '1-Urgent', '2-High', '3-Medium', '5-Low', 'Not Specified', 'Unavailable'], label) AS INTEGER) AS answer_position
FROM placed GROUP BY variable, label HAVING question_position > 0 AND answer_position > 0""",
    ),
    "summary_count": with_views(
        CONDITION_ROWS,
        "SELECT condition, CAST(row_number() OVER (ORDER BY max(CASE WHEN cohort_label = 'All alpha' THEN n END) "
        "DESC NULLS LAST, variable) AS INTEGER) AS position, "
        + ", ".join(
            f"coalesce(max(CASE WHEN cohort_label = '{c}' THEN n || ' (' || CAST(round_even(100.0 * n / n_group, 1) "
            f"AS VARCHAR) || '%)' END), '0 (0.0%)') AS \"{c}\""
            for c in ALL
        )
        + " FROM condition_counts GROUP BY variable, condition HAVING max(n) > 0",
    ),
    "care_summary": with_views(
        CARE, CARE_ANSWERS, FULL, COUNTED,
        """named AS (
  SELECT *, CASE value WHEN 'a' THEN 'Place A' WHEN 'n' THEN 'Place N' WHEN 'multiple' THEN 'Multiple locations'
    WHEN 'unavailable' THEN 'Unavailable' WHEN 'other' THEN 'Other' WHEN 'yes' THEN 'Yes' WHEN 'no' THEN 'No'
    ELSE value END AS label FROM shares)""",
        f"""SELECT variable, label AS value, {_percent_cells(ALL)},
  CAST(list_position(['care_cleaned', 'hospitalized'], variable) AS INTEGER) AS question_position,
  CAST(list_position(['Place A', 'Place N', 'Multiple locations', 'Other', 'Yes', 'No', 'Unavailable'], label)
    AS INTEGER) AS answer_position
FROM named GROUP BY variable, label""",
    ),
    "summary_continuous": with_views(
        "SELECT cohort, printf('%.1f', avg(balance)) || ' ± ' || printf('%.1f', stddev_samp(balance)) AS mean_sd, "
        "CAST(round(median(balance), 4) AS VARCHAR) AS median, "
        "CAST(round(min(balance), 4) AS VARCHAR) || ' - ' || CAST(round(max(balance), 4) AS VARCHAR) AS min_max "
        "FROM participants GROUP BY 1"
    ),
    "contingency": with_views(
        DEMOGRAPHIC_ANSWERS, FULL, COUNTED,
        "SELECT variable, value, "
        + ", ".join(f"CAST(sum(CASE WHEN cohort_label = '{c}' THEN n ELSE 0 END) AS BIGINT) AS \"{c}\"" for c in ALL)
        + " FROM counted GROUP BY 1, 2",
    ),
    "flag_crosstab": with_views(
        "SELECT coalesce(cond_a, false) AS cond_a, coalesce(cond_b, false) AS cond_b, coalesce(cond_ab, false) AS "
        "cond_ab, count(DISTINCT user_id) AS n_users FROM participants GROUP BY 1, 2, 3"
    ),
    "collapse_flags": with_views(
        f"SELECT user_id, cond_a, cond_b, cond_ab, {ANY_FLAGS} AS cond_any FROM participants"
    ),
    "item_order": with_views(
        "sums AS ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS variable, count({c}) AS n FROM participants WHERE cohort = 'alpha'"
            for c in ("cond_a", "cond_b", "cond_ab")
        )
        + ")",
        "SELECT variable, n, CAST(row_number() OVER (ORDER BY n DESC, variable) AS INTEGER) AS position FROM sums",
    ),
    "chi_square": with_views(DEMOGRAPHIC_ANSWERS, FULL, COUNTED, CHI_CELLS, CHI_RESULT),
    "chi_square_dense": with_views(DEMOGRAPHIC_ANSWERS, ACTIVITY, COUNTED, CHI_CELLS, CHI_RESULT),
    "chi_square_care": with_views(CARE, CARE_ANSWERS, FULL, COUNTED, CHI_CELLS, CHI_RESULT),
    "chi_square_symptoms": with_views(
        SYMPTOM_ANSWERS, FULL,
        "counted AS (SELECT cohort_label, 'symptoms' AS variable, variable AS value, count(*) AS n FROM answers "
        "JOIN sets USING (user_id) WHERE value <> '' GROUP BY ALL)",
        CHI_CELLS, CHI_RESULT,
    ),
    "two_prop_z": with_views(DEMOGRAPHIC_ANSWERS, EVERY, *_z_steps(PAIRS), Z_RESULT),
    "two_prop_z_dense": with_views(
        DEMOGRAPHIC_ANSWERS, ACTIVITY, *_z_steps([("Dense Activity", "Non-dense Activity")]), Z_RESULT
    ),
    "two_prop_z_care": with_views(CARE, CARE_ANSWERS, EVERY, *_z_steps(PAIRS), Z_RESULT),
    "two_prop_z_symptoms": with_views(SYMPTOM_ANSWERS, EVERY, *_z_steps(PAIRS), Z_RESULT),
    "symptom_totals": with_views(
        f"SELECT cohort, count(*) AS n_rows, {_list([f'count({s}) AS {s}' for s in SYMPTOMS])} FROM survey GROUP BY 1"
    ),
    "top_symptoms": with_views(
        PRESENT,
        "SELECT symptom, alpha, beta, alpha + beta AS total, "
        f"{_round('alpha / (alpha + beta)')} AS share, "
        + _round("100.0 * alpha / (SELECT count(*) FROM survey WHERE cohort = 'alpha')") + " AS alpha_percent, "
        + _round("100.0 * beta / (SELECT count(*) FROM survey WHERE cohort = 'beta')") + " AS beta_percent, "
        "CAST(row_number() OVER (ORDER BY alpha / (alpha + beta), symptom) AS INTEGER) AS position "
        "FROM symptom_counts WHERE symptom IN (SELECT symptom FROM top)",
    ),
    "symptom_sets": with_views(
        PRESENT,
        """user_sets AS (
  SELECT s.user_id, s.cohort, coalesce(string_agg(p.symptom, '+' ORDER BY p.symptom), '') AS symptom_set,
    CAST(count(p.symptom) AS INTEGER) AS cardinality
  FROM survey s LEFT JOIN (SELECT * FROM present WHERE symptom IN (SELECT symptom FROM top)) p
    ON p.user_id = s.user_id
  WHERE s.cohort IN ('alpha', 'beta') GROUP BY 1, 2),
sized AS (
  SELECT symptom_set, cardinality, count(CASE WHEN cohort = 'alpha' THEN 1 END) AS alpha,
    count(CASE WHEN cohort = 'beta' THEN 1 END) AS beta, count(*) AS total FROM user_sets GROUP BY 1, 2)""",
        "SELECT *, CAST(row_number() OVER (ORDER BY total DESC, cardinality DESC, symptom_set) AS INTEGER) AS position "
        "FROM sized WHERE total >= 0.02 * (SELECT count(*) FROM user_sets)",
    ),
    "peak_day": with_views(DAILY, _peaks(2, 2), "SELECT cohort, variable, peak_day FROM peaks"),
    "peak_day_trailing": with_views(DAILY, _peaks(4, 0), PANEL_ORDER, "SELECT * FROM panel_order"),
    "symptom_summary": with_views(
        SYMPTOM_ANSWERS, FULL, COUNTED, DAILY, _peaks(2, 2),
        "pairs AS (SELECT * FROM (VALUES "
        + ", ".join(f"('{i}', '{k}')" for i, k in zip(ITEMS, KINDS))
        + ") AS t(item, symptom))",
        "wide AS (SELECT replace(variable, 'symptoms__', '') AS symptom, "
        + ", ".join(f"max(CASE WHEN cohort_label = 'All {c}' THEN percent END) AS {c}" for c in COHORTS)
        + " FROM shares WHERE value <> '' GROUP BY 1)",
        "SELECT symptom, CAST(row_number() OVER (ORDER BY alpha DESC NULLS LAST, symptom) AS INTEGER) AS position, "
        + ", ".join(
            f"coalesce(CAST(round_even({c}, 1) AS VARCHAR) || '%', 'NA') AS \"All {c}\", "
            f"coalesce((SELECT CAST(peak_day AS VARCHAR) FROM peaks WHERE cohort = '{c}' AND variable = item), 'NA') "
            f'AS "All {c} peak"'
            for c in COHORTS
        )
        + " FROM wide JOIN pairs USING (symptom)",
    ),
    "prevalence_by_day": with_views(
        DAILY, _peaks(4, 0), PANEL_ORDER,
        "SELECT variable, days_since_onset, position, "
        + ", ".join(_round(f"max(CASE WHEN cohort = '{c}' THEN percent END)") + f" AS {c}" for c in COHORTS)
        + " FROM daily_totals JOIN panel_order USING (variable) GROUP BY ALL",
    ),
    "duration_median": with_views(
        DURATION, "SELECT cohort, count(*) AS n, median(duration) AS median FROM ill GROUP BY 1"
    ),
    "duration_density": with_views(
        DURATION,
        """width AS (
  SELECT cohort, count(*) AS n, min(duration) AS lo, max(duration) AS hi,
    stddev_samp(duration) * pow(count(*), -0.2) AS bw FROM ill GROUP BY 1),
points AS (
  SELECT w.*, CAST(i AS INTEGER) AS point, lo - 3 * bw + i * (hi - lo + 6 * bw) / 199 AS x
  FROM width w CROSS JOIN range(0, 200) AS r(i))""",
        f"""SELECT p.cohort, point, {_round('x')} AS x,
  {_round('sum(exp(-0.5 * pow((x - duration) / bw, 2))) / any_value(n * bw) / sqrt(2 * pi())', 8)} AS density
FROM points p JOIN ill USING (cohort) GROUP BY p.cohort, point, x""",
    ),
    "rank_sum_pairs": with_views(
        DURATION,
        """both_sides AS (
  SELECT a.cohort AS cohort_a, b.cohort AS cohort_b,
    sum(CASE WHEN a.duration > b.duration THEN 1.0 WHEN a.duration = b.duration THEN 0.5 ELSE 0.0 END) AS u
  FROM ill a JOIN ill b ON a.cohort < b.cohort GROUP BY 1, 2),
ties AS (
  SELECT cohort_a, cohort_b, sum(CAST(t AS DOUBLE) ** 3 - t) AS ties FROM (
    SELECT cohort_a, cohort_b, duration, count(*) AS t FROM both_sides JOIN ill ON cohort IN (cohort_a, cohort_b)
    GROUP BY ALL) GROUP BY 1, 2),
sizes AS (SELECT cohort, count(*) AS n FROM ill GROUP BY 1),
ranked AS (
  SELECT s.cohort_a, s.cohort_b, a.n AS n_a, b.n AS n_b, u,
    greatest(abs(u - a.n * b.n / 2.0) - 0.5, 0)
      / sqrt(a.n * b.n / 12.0 * (a.n + b.n + 1 - ties / ((a.n + b.n) * (a.n + b.n - 1.0)))) AS z
  FROM both_sides s JOIN ties USING (cohort_a, cohort_b) JOIN sizes a ON a.cohort = cohort_a
  JOIN sizes b ON b.cohort = cohort_b)""",
        f"SELECT cohort_a, cohort_b, n_a, n_b, CAST(u AS DOUBLE) AS u, {_round('z')} AS z, "
        f"{_round(_two_sided('z'))} AS p_value FROM ranked",
    ),
    "valid_user_counts": with_views(
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT cohort, '{c}' AS channel, count(DISTINCT user_id) AS n_users FROM activity_panel "
            f"WHERE valid_user__{c} = 1 GROUP BY 1"
            for c in CHANNELS
        )
        + ")"
    ),
    "zscore_user": with_views(
        "SELECT user_id, study_date, "
        + ", ".join(
            _round(
                f"({c}__observed - avg({c}__observed) OVER w) / nullif(stddev_samp({c}__observed) OVER w, 0)"
            )
            + f" AS {c}__observed_z"
            for c in CHANNELS
        )
        + " FROM activity_panel WINDOW w AS (PARTITION BY user_id)"
    ),
    "user_rank": with_views(RANKS, "SELECT user_id, user_rank FROM ranks"),
    "coverage_grid": with_views(
        RANKS,
        "channel_days AS ("
        + " UNION ALL ".join(
            f"SELECT user_id, cohort, study_date, days_since_onset, '{name}' AS channel, valid_day__{c} AS day_validity, "
            f"valid_user__{c} AS user_validity FROM activity_panel"
            for c, name in (("steps", "Steps"), ("heart", "RHR"), ("sleep", "Sleep"))
        )
        + ")",
        "SELECT c.user_id, cohort, study_date, user_rank, channel, "
        "CASE WHEN days_since_onset IS NULL THEN NULL WHEN days_since_onset = 0 THEN 'Symptoms Onset' "
        "WHEN day_validity = 0 THEN 'no observation' ELSE cohort || ' observation' END AS day_type "
        "FROM channel_days c LEFT JOIN ranks r ON r.user_id = c.user_id WHERE user_validity = 1",
    ),
    "elevated_rate": with_views(
        ELEVATED,
        ELEVATED_RATES,
    ),
    "lmm_level_products": with_views(
        MODEL_ROWS, CENTRED,
        "SELECT model, day_of_week AS level, count(*) AS n, "
        + ", ".join(binary(f"sum(x{i})") + f" AS z{i}" for i in range(5))
        + ", "
        + ", ".join(binary(f"sum(x{i} * x{j})") + f" AS p{i}_{j}" for i in range(5) for j in range(i, 5))
        + " FROM centred GROUP BY 1, 2",
    ),
    "lmm_size_products": with_views(
        MODEL_ROWS, CENTRED, USER_CENTRED,
        "SELECT model, n, count(*) AS users, "
        + ", ".join(binary(f"sum(c{i} * c{j})") + f" AS b{i}_{j}" for i in range(12) for j in range(i, 12))
        + " FROM user_centred GROUP BY 1, 2",
    ),
    "impute_by_state": with_views(
        "filled AS (SELECT user_id, study_date, "
        + ", ".join(
            f"CASE WHEN valid_user__{c} = 1 THEN coalesce({c}__observed, {STATE[c]} * {k}) END AS {c}__imputed, "
            f"CASE WHEN valid_user__{c} = 1 AND (valid_day__{c} <> 1 OR {c}__observed IS NULL) THEN 1 ELSE 0 END "
            f"AS {c}__was_imputed"
            for c, k in (("steps", 1000.0), ("heart", 1.0), ("sleep", 60.0))
        )
        + " FROM activity_panel)",
        "SELECT user_id, study_date, "
        + ", ".join(
            f"{c}__was_imputed, {_round(f'{c}__imputed', 5)} AS {c}__imputed, "
            + _round(f"({c}__imputed - avg({c}__imputed) OVER w) / nullif(stddev_samp({c}__imputed) OVER w, 0)", 5)
            + f" AS {c}__imputed_z"
            for c in CHANNELS
        )
        + " FROM filled WINDOW w AS (PARTITION BY user_id)",
    ),
    "excess_by_state": with_views(
        "excess AS ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS channel, cohort, days_since_onset, {c}__observed - {STATE[c]} * {k} AS excess "
            f"FROM activity_panel WHERE valid_user__{c} = 1 AND valid_day__{c} = 1"
            for c, k in (("steps", 1000.0), ("sleep", 60.0))
        )
        + ")",
        f"SELECT channel, cohort, days_since_onset, {_round('avg(excess)', 5)} AS mean_excess, count(excess) AS n_days "
        "FROM excess WHERE days_since_onset BETWEEN -10 AND 20 GROUP BY 1, 2, 3",
    ),
    "error_bars": with_views(
        "shares AS (SELECT cohort, days_since_onset, count(*) AS n, avg(valid_day__heart) AS share "
        "FROM activity_panel GROUP BY 1, 2)",
        f"SELECT cohort, days_since_onset, n, {_round('share')} AS share, {_round('share * (1 - share) / n', 8)} "
        "AS variance FROM shares",
    ),
    "spread_medians": with_views(
        "SELECT cohort, round(median(balance), 4) AS median FROM participants GROUP BY 1"
    ),
    "lmm_user_sums": with_views(
        MODEL_ROWS,
        "SELECT model, user_id, count(*) AS n, "
        + ", ".join(
            _round(f"sum({x})", 4) + f" AS s_{j}" for j, x in enumerate(("week_L", "week_Q", "week_C", "state"))
        )
        + ", "
        + ", ".join(f"count(CASE WHEN day_of_week = '{w}' THEN 1 END) AS d_{k}" for k, w in enumerate(LATER_WEEKDAYS))
        + f", {_round('sum(y)', 4)} AS s_y FROM model_rows GROUP BY 1, 2",
    ),
}
ORACLE |= model_oracle(
    ELEVATED.replace("heart__observed", "heart__imputed").replace("activity_panel", "outputs"), ELEVATED_RATES
)

CONTINUOUS = """held AS (
  SELECT cohort_label, 'balance' AS variable, balance AS value FROM participants JOIN membership USING (user_id)
  UNION ALL
  SELECT cohort_label, 'largest_order', o_totalprice FROM (
    SELECT o_custkey AS user_id, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) JOIN membership USING (user_id)),
numbered AS (
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY cohort_label, variable) AS n FROM held
  WHERE value IS NOT NULL WINDOW w AS (PARTITION BY cohort_label, variable ORDER BY value)),
texts AS (
  SELECT cohort_label, variable, unnest(['Mean ± SD', 'Median', 'Min - Max']) AS statistic,
    unnest([printf('%.1f', avg(value)) || ' ± ' || printf('%.1f', stddev_samp(value)),
      CAST((max(CASE WHEN place = (n + 1) // 2 THEN value END) + max(CASE WHEN place = n // 2 + 1 THEN value END)) / 2.0
        AS VARCHAR),
      CAST(min(value) AS VARCHAR) || ' - ' || CAST(max(value) AS VARCHAR)]) AS cell
  FROM numbered GROUP BY 1, 2)"""
REGION_RANKS = """nation_cents AS (
  SELECT r_name AS side, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, n_nationkey),
sides AS (SELECT side, count(*) AS n FROM nation_cents GROUP BY 1),
compared AS (
  SELECT a.side AS cohort_a, b.side AS cohort_b,
    sum(CASE WHEN a.cents > b.cents THEN 1.0 WHEN a.cents = b.cents THEN 0.5 ELSE 0.0 END) AS u
  FROM nation_cents a JOIN nation_cents b ON a.side < b.side GROUP BY 1, 2),
sized AS (
  SELECT cohort_a, cohort_b, a.n AS n_a, b.n AS n_b, CAST(u AS DOUBLE) AS u FROM compared
  JOIN sides a ON a.side = cohort_a JOIN sides b ON b.side = cohort_b),
arranged AS (
  SELECT cohort_a, cohort_b, list_sum(list_transform(range(0, n_a + n_b), lambda i: (i + 1) * ((mask >> i) & 1)))
    - n_a * (n_a + 1) / 2 AS arranged_u
  FROM sized, range(0, 1024) AS m(mask)
  WHERE mask < (1 << (n_a + n_b)) AND bit_count(mask) = n_a)"""
DENSITY_CELLS = """spans AS (
  SELECT cohort, count(balance) AS n, min(balance) AS lo, max(balance) AS hi,
    stddev_samp(balance) * pow(count(balance), -0.2) AS bw FROM participants WHERE balance IS NOT NULL GROUP BY 1),
shared AS (
  SELECT cohort, lo + least(floor((balance - lo) / ((hi - lo) / 1023)), 1022) * ((hi - lo) / 1023) AS node,
    (balance - lo) / ((hi - lo) / 1023) - least(floor((balance - lo) / ((hi - lo) / 1023)), 1022) AS right_part
  FROM participants JOIN spans USING (cohort)),
nodes AS (
  SELECT cohort, node, count(*) - sum(right_part) AS weight FROM shared GROUP BY 1, 2
  UNION ALL SELECT cohort, node + (hi - lo) / 1023, sum(right_part) FROM shared JOIN spans USING (cohort) GROUP BY 1, 2),
grid_points AS (
  SELECT s.*, CAST(i AS INTEGER) AS point, lo - 3 * bw + i * (hi - lo + 6 * bw) / 199 AS x
  FROM spans s CROSS JOIN range(0, 200) AS r(i))"""
ORACLE |= {
    "summary_continuous_cohorts": with_views(
        CONTINUOUS,
        "SELECT variable, statistic, "
        + ", ".join(f"max(CASE WHEN cohort_label = '{c}' THEN cell END) AS \"{c}\"" for c in ALL + DENSE)
        + " FROM texts GROUP BY 1, 2",
    ),
    "summary_headers": with_views(
        DEMOGRAPHIC_ANSWERS, FULL, COUNTED,
        "headers AS (SELECT cohort_label, cohort_label || ' (N=' || count(DISTINCT user_id) || ')' AS header FROM sets GROUP BY 1)",
        "filled AS (SELECT variable, value, header, coalesce(max(CAST(round_even(percent, 1) AS VARCHAR) || '%'), '0.0%') AS cell "
        "FROM (SELECT DISTINCT variable, value FROM counted) CROSS JOIN headers "
        "LEFT JOIN shares USING (cohort_label, variable, value) GROUP BY 1, 2, 3)",
        "PIVOT filled ON header USING max(cell) GROUP BY variable, value",
    ),
    "answers_complete": with_views(
        DEMOGRAPHIC_ANSWERS, EVERY, COUNTED,
        "SELECT cohort_label, variable, CAST(sum(n) AS BIGINT) AS n_answers, count(*) AS n_distinct FROM counted GROUP BY 1, 2",
    ),
    "activity_set_sizes": with_views("SELECT cohort_label, count(DISTINCT user_id) AS n_users FROM activity_sets GROUP BY 1"),
    "symptom_set_count": with_views(
        PRESENT,
        """user_sets AS (
  SELECT s.user_id, coalesce(string_agg(p.symptom, '+' ORDER BY p.symptom), '') AS symptom_set
  FROM survey s LEFT JOIN (SELECT * FROM present WHERE symptom IN (SELECT symptom FROM top)) p ON p.user_id = s.user_id
  WHERE s.cohort IN ('alpha', 'beta') GROUP BY 1)""",
        "SELECT count(DISTINCT symptom_set) AS n_sets, count(*) AS n_reports FROM user_sets",
    ),
    "rank_sum_exact": with_views(
        REGION_RANKS,
        f"""SELECT s.cohort_a, s.cohort_b, n_a, n_b, u,
  {_round('greatest(abs(u - n_a * n_b / 2.0) - 0.5, 0) / sqrt(n_a * n_b / 12.0 * (n_a + n_b + 1))')} AS z,
  {_round('least(1.0, 2.0 * count(CASE WHEN arranged_u >= greatest(u, n_a * n_b - u) THEN 1 END) / count(*))')} AS p_value
FROM sized s JOIN arranged a ON a.cohort_a = s.cohort_a AND a.cohort_b = s.cohort_b GROUP BY s.cohort_a, s.cohort_b, n_a, n_b, u""",
    ),
    "density_continuous": with_views(
        DENSITY_CELLS,
        f"""SELECT p.cohort, point, {_round('x')} AS x,
  {_round('sum(weight * exp(-0.5 * pow((x - node) / bw, 2))) / any_value(n * bw) / sqrt(2 * pi())', 10)} AS density
FROM grid_points p JOIN nodes USING (cohort) GROUP BY p.cohort, point, x""",
    ),
    "coverage_order": "SELECT cohort, channel, day_type, count(*) AS n_days, "
    "CASE cohort WHEN 'alpha' THEN 1 WHEN 'gamma' THEN 2 WHEN 'beta' THEN 3 END AS cohort_position, "
    "CASE channel WHEN 'Steps' THEN 1 WHEN 'RHR' THEN 2 WHEN 'Sleep' THEN 3 END AS channel_position, "
    "CASE day_type WHEN 'Symptoms Onset' THEN 1 WHEN 'alpha observation' THEN 2 WHEN 'gamma observation' THEN 3 "
    "WHEN 'beta observation' THEN 4 WHEN 'no observation' THEN 5 END AS day_type_position "
    f"FROM ({ORACLE['coverage_grid']}) GROUP BY cohort, channel, day_type",
    "derived_names": with_views(
        "SELECT user_id, " + ", ".join(f'symptoms__{k} AS "felt {k}"' for k in KINDS) + " FROM survey"
    ),
}
