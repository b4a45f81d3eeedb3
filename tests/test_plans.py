"""Physical plans on written tables: filters and columns reach the scan, and nothing pairs rows."""

from __future__ import annotations

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from panelwise.operators import mixed, panel, smooth, timecourse
from panelwise.plans import study
from panelwise.session import cut
from panelwise.sources import testviews as tv

FOLDER = "/root/testdata/sf0.001"
USER, COHORT, DAY = "user_id", "cohort", "days_since_onset"


@pytest.fixture(scope="module")
def days(spark):
    return cut(tv.activity_panel(spark, FOLDER), USER)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_elevated_rate_reads_four_columns_of_valid_users(days):
    valid = days.filter("valid_user__heart = 1")
    scored = panel.zscores(valid, USER, ["heart__observed"])
    plan = plan_of(timecourse.elevated_rate(scored, COHORT, DAY, USER, "heart__observed_z", [0.0, 1.0]))
    scans = re.findall(r"PushedFilters: \[(.*?)\], ReadSchema: struct<(.*?)>", plan)
    assert scans
    for filters, columns in scans:
        assert "EqualTo(valid_user__heart,1)" in filters
        names = {c.split(":")[0] for c in columns.split(",")}
        assert names <= {USER, COHORT, DAY, "valid_user__heart", "heart__observed", "..."}
    assert len(scans) <= 3
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_scores_use_no_window_over_a_user(days):
    plan = plan_of(panel.zscores(days, USER, ["steps__observed"]))
    assert "Window" not in plan and "HashAggregate" in plan


def test_combination_counts_read_the_events_once(spark):
    events = cut(tv.events_survey(spark, FOLDER))
    combos = study.combination_counts(events, COHORT, [f"symptoms__{s}" for s in tv.SYMPTOMS])
    plan = plan_of(study.symptom_sets(combos, COHORT, ["alpha", "beta"], 3))
    assert "symptoms__" not in plan  # only the short table of combinations is read again
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_daily_reports_combine_before_the_shuffle(spark, days):
    plan = plan_of(timecourse.daily_reports(days, [COHORT], DAY, ["steps__observed", "sleep__observed"]))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning")


@pytest.fixture
def hot_user(spark):
    """300,000 rows, 60 percent of them of one user, under limits at which that is skew."""
    users = F.when(F.col("id") % 5 < 3, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.col("id") % 997))
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    }
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield spark.range(0, 300_000, 1, 16).select(users.alias("user_id"), F.rand(1).alias("v"))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_predictions_split_a_user_with_most_rows(hot_user):
    effects = hot_user.select("user_id").distinct().select("user_id", F.lit("m").alias("model"), F.lit(2.0).alias("effect"))
    fits = SimpleNamespace(
        specs=[SimpleNamespace(name="m")], user="user_id", user_effects=lambda: effects, fixed_part=lambda spec: F.col("v")
    )
    got = mixed.MixedFits.predict(fits, hot_user)
    assert len(got.toPandas()) == 300_000
    assert "skew=true" in plan_of(got)


def test_scores_split_a_user_with_most_rows(hot_user):
    got = panel.zscores(hot_user, "user_id", ["v"])
    held = got.toPandas()
    assert "skew=true" in plan_of(got)
    own = held.groupby("user_id")["v"]
    expected = (held["v"] - own.transform("mean")) / own.transform("std")
    assert len(held) == 300_000 and (held["v_z"] - expected).abs().max() < 1e-9


def test_curves_need_no_join_on_days(spark, monkeypatch):
    """The basis is in the plan; users' sums are the only rows that move, and none are paired."""
    rows = [("a", f"u{u}", d, float(u + d)) for u in range(6) for d in range(-10, 21)]
    df = spark.createDataFrame(rows, "cohort string, user_id string, day int, y double")
    seen = []
    real = smooth._between
    monkeypatch.setattr(smooth, "_between", lambda *args: seen.append(real(*args)) or seen[-1])
    smooth.fit_curves(df, ["cohort"], "user_id", "day", "y").collect()
    plan = plan_of(seen[0])
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") <= 2
