"""The study-shaped views once more, as plain SQL for the oracle."""

VIEWS = """
day_activity AS (
  SELECT user_id, CAST(ts AS DATE) AS study_date,
    sum(CASE WHEN event_type = 'click' THEN value END) AS steps_raw,
    avg(CASE WHEN event_type = 'view' THEN value END) AS heart_raw,
    sum(CASE WHEN event_type = 'purchase' THEN value END) AS sleep_raw,
    count(CASE WHEN event_type = 'click' THEN 1 END) AS n_click,
    count(CASE WHEN event_type = 'error' THEN 1 END) AS n_error,
    count(CASE WHEN event_type = 'purchase' THEN 1 END) AS n_purchase,
    count(CASE WHEN event_type = 'signup' THEN 1 END) AS n_signup,
    count(CASE WHEN event_type = 'view' THEN 1 END) AS n_view
  FROM events GROUP BY 1, 2),
person AS (
  SELECT user_id, min(CASE WHEN n_error > 0 THEN study_date END) AS date_onset,
    CASE WHEN count(steps_raw) >= 10 THEN 1 ELSE 0 END AS valid_user__steps,
    CASE WHEN count(heart_raw) >= 10 THEN 1 ELSE 0 END AS valid_user__heart,
    CASE WHEN count(sleep_raw) >= 10 THEN 1 ELSE 0 END AS valid_user__sleep
  FROM day_activity GROUP BY 1),
calendar AS (SELECT DISTINCT CAST(ts AS DATE) AS study_date FROM events),
span AS (
  SELECT min(study_date) AS first_date, date_diff('day', min(study_date), max(study_date)) // 7 + 1 AS weeks
  FROM calendar),
grid AS (
  SELECT p.user_id, c.study_date, p.date_onset, p.valid_user__steps, p.valid_user__heart, p.valid_user__sleep,
    d.steps_raw, d.heart_raw, d.sleep_raw, d.n_click, d.n_error, d.n_purchase, d.n_signup, d.n_view,
    CASE p.user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS cohort,
    CAST(date_diff('day', p.date_onset, c.study_date) AS INTEGER) AS days_since_onset,
    dayname(c.study_date) AS day_of_week,
    date_diff('day', s.first_date, c.study_date) // 7 AS week, s.weeks
  FROM person p CROSS JOIN calendar c CROSS JOIN span s
  LEFT JOIN day_activity d ON d.user_id = p.user_id AND d.study_date = c.study_date),
unchecked_panel AS (
  SELECT user_id, study_date, cohort, valid_user__steps, valid_user__heart, valid_user__sleep,
    CASE WHEN steps_raw IS NULL THEN 0 ELSE 1 END AS valid_day__steps,
    CASE WHEN heart_raw IS NULL THEN 0 ELSE 1 END AS valid_day__heart,
    CASE WHEN sleep_raw IS NULL THEN 0 ELSE 1 END AS valid_day__sleep,
    steps_raw AS steps__observed, heart_raw AS heart__observed, sleep_raw AS sleep__observed
  FROM grid),
kept AS (
  SELECT *, CASE WHEN valid_user__steps = 1 THEN steps_raw END AS steps__observed,
    CASE WHEN valid_user__heart = 1 THEN heart_raw END AS heart__observed,
    CASE WHEN valid_user__sleep = 1 THEN sleep_raw END AS sleep__observed
  FROM grid),
state AS (
  SELECT study_date, avg(steps__observed) AS state_steps, avg(heart__observed) AS state_heart,
    avg(sleep__observed) AS state_sleep
  FROM kept GROUP BY 1),
activity_panel AS (
  SELECT k.user_id, k.study_date, cohort, date_onset, days_since_onset, day_of_week,
    CASE WHEN days_since_onset < -2 OR days_since_onset > 10 THEN 'baseline' ELSE 'event' END AS flu_period,
    valid_user__steps, valid_user__heart, valid_user__sleep,
    CASE WHEN steps__observed IS NULL THEN 0 ELSE 1 END AS valid_day__steps,
    CASE WHEN heart__observed IS NULL THEN 0 ELSE 1 END AS valid_day__heart,
    CASE WHEN sleep__observed IS NULL THEN 0 ELSE 1 END AS valid_day__sleep,
    steps__observed, heart__observed, sleep__observed,
    (week - (weeks - 1) / 2.0) / sqrt(weeks * (weeks * weeks - 1) / 12.0) AS week_L,
    ((week - (weeks - 1) / 2.0) ** 2 - (weeks * weeks - 1) / 12.0)
      / sqrt(weeks * (weeks * weeks - 1) * (weeks * weeks - 4) / 180.0) AS week_Q,
    ((week - (weeks - 1) / 2.0) ** 3 - (week - (weeks - 1) / 2.0) * (3 * weeks * weeks - 7) / 20.0)
      / sqrt(weeks * (weeks * weeks - 1) * (weeks * weeks - 4) * (weeks * weeks - 9) / 2800.0) AS week_C,
    state_steps / 1000 AS state__steps__scale1k, state_heart AS state__heart,
    state_sleep / 60 AS state__sleep__scale60
  FROM kept k LEFT JOIN state s ON s.study_date = k.study_date),
daily_symptoms AS (
  SELECT user_id, study_date, cohort, days_since_onset,
    CASE WHEN n_click > 0 THEN 1.0::DOUBLE END AS daily_symp__click,
    CASE WHEN n_error > 0 THEN 1.0::DOUBLE END AS daily_symp__error,
    CASE WHEN n_purchase > 0 THEN 1.0::DOUBLE END AS daily_symp__purchase,
    CASE WHEN n_signup > 0 THEN 1.0::DOUBLE END AS daily_symp__signup,
    CASE WHEN n_view > 0 THEN 1.0::DOUBLE END AS daily_symp__view,
    CAST(NULL AS DOUBLE) AS daily_symp__never
  FROM grid),
first_orders AS (
  SELECT o_custkey AS user_id, o_orderkey AS order_key, CAST(o_orderdate AS DATE) AS date_onset,
    lower(o_orderpriority) AS priority
  FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1),
participants AS (
  SELECT c_custkey AS user_id,
    CASE c_custkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS cohort,
    lower(r_name) AS area, lower(nullif(c_mktsegment, 'MACHINERY')) AS segment,
    CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 2500 THEN '< 2500' WHEN c_acctbal < 5000 THEN '2500 - 4999'
      WHEN c_acctbal < 7500 THEN '5000 - 7499' ELSE '7500 +' END AS balance_group,
    c_acctbal AS balance,
    CASE WHEN c_custkey % 7 = 0 THEN TRUE END AS cond_a, CASE WHEN c_custkey % 11 = 0 THEN TRUE END AS cond_b,
    CASE WHEN c_custkey % 13 = 0 THEN TRUE END AS cond_ab,
    priority, valid_user__steps, valid_user__heart, valid_user__sleep
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN first_orders f ON f.user_id = c_custkey LEFT JOIN person p ON p.user_id = c_custkey),
first_items AS (
  SELECT f.order_key, l_linenumber, l_partkey, l_quantity, lower(l_returnflag) AS flag, l_linestatus,
    lower(p_type) AS kind
  FROM first_orders f JOIN lineitem ON l_orderkey = f.order_key LEFT JOIN part ON p_partkey = l_partkey),
item_answers AS (
  SELECT order_key, CAST(max(l_quantity) AS INTEGER) AS days_ill,
    max(CASE WHEN kind = 'economy' THEN kind END) AS symptoms__economy,
    max(CASE WHEN kind = 'large' THEN kind END) AS symptoms__large,
    max(CASE WHEN kind = 'medium' THEN kind END) AS symptoms__medium,
    max(CASE WHEN kind = 'promo' THEN kind END) AS symptoms__promo,
    max(CASE WHEN kind = 'small' THEN kind END) AS symptoms__small,
    max(CASE WHEN kind = 'standard' THEN kind END) AS symptoms__standard,
    string_agg(DISTINCT flag, '__' ORDER BY flag) AS care
  FROM first_items GROUP BY 1),
item_status AS (
  SELECT order_key, l_linestatus AS status FROM first_items
  QUALIFY row_number() OVER (PARTITION BY order_key ORDER BY l_linenumber, l_partkey, l_linestatus) = 1),
survey AS (
  SELECT f.user_id, CASE f.user_id % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS cohort,
    f.date_onset, f.date_onset + a.days_ill AS date_recovery,
    symptoms__economy, symptoms__large, symptoms__medium, symptoms__promo, symptoms__small, symptoms__standard,
    coalesce(care, 'unavailable') AS care_where,
    CASE status WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' END AS hospitalized
  FROM first_orders f LEFT JOIN item_answers a ON a.order_key = f.order_key
  LEFT JOIN item_status s ON s.order_key = f.order_key),
dense_users AS (
  SELECT user_id FROM participants
  WHERE coalesce(valid_user__steps, 0) + coalesce(valid_user__heart, 0) + coalesce(valid_user__sleep, 0) > 0),
membership AS (
  SELECT 'All ' || cohort AS cohort_label, user_id FROM participants
  UNION ALL
  SELECT 'Dense ' || cohort, user_id FROM participants WHERE user_id IN (SELECT user_id FROM dense_users)),
activity_sets AS (
  SELECT CASE WHEN user_id IN (SELECT user_id FROM dense_users) THEN 'Dense Activity' ELSE 'Non-dense Activity' END
    AS cohort_label, user_id FROM participants)
"""


def with_views(*steps_and_query: str) -> str:
    """One statement: the views, further named steps, and the query that comes last."""
    *steps, query = steps_and_query
    return "WITH " + ",\n".join([VIEWS.strip(), *steps]) + "\n" + query
