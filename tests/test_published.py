"""The published results on a small random study in the declared schemas, against pandas where it is short."""

from __future__ import annotations

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwise.plans import published, study
from panelwise.sources import labels, schemas

N = 90


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(11)
    day0 = datetime.date(2020, 1, 1)
    people, events, symptom_days, panel = [], [], [], []
    education = ["doctorate degree, md", "some college, no degree", "trade/technical/vocational training", None]
    for i in range(N):
        user, cohort = f"u{i:03d}", labels.COHORTS[i % 3]
        valid = {c: int(rng.random() < 0.7) for c in schemas.CHANNELS}
        people.append(
            {
                "user_id": user, "cohort": cohort, **{f"valid_user__{c}": v for c, v in valid.items()},
                "gender": rng.choice(["female", "male", "other"]), "education": rng.choice(education),
                "age_group": rng.choice(["25-34", "35-44", "55 +"]), "bmi_group": rng.choice(["30 +", None]),
                "race": rng.choice(["white / caucasian", "i'd prefer not to answer"]),
                **{c: True if rng.random() < 0.2 else None for c in schemas.BOWEL_FLAGS + schemas.CONDITIONS},
                "hs_completed": True,
            }
        )
        onset = day0 + datetime.timedelta(days=20 + rng.randrange(10))
        events.append(
            {
                "user_id": user, "cohort": cohort,
                **{f"symptoms__{s}": s if rng.random() < 0.4 else None for s in schemas.SYMPTOMS},
                "date_onset_merged": onset,
                "date_recovery_merged": onset + datetime.timedelta(days=rng.randrange(1, 20)) if rng.random() < 0.9 else None,
                "medical__sought_attention_where": rng.choice(["urgent care facility", "a__b", "elsewhere", "unavailable"]),
                "medical__hospitalized": rng.choice(["yes", "no", None]), "medical__medication": rng.choice(["yes", None]),
            }
        )
        level = rng.gauss(0, 3)
        for day in range(-15, 25):
            date = onset + datetime.timedelta(days=day)
            symptom_days.append(
                {
                    "user_id": user, "cohort": cohort, "days_since_symptoms_onset": day,
                    **{f"daily_symp__{s}": float(rng.random() < 0.3) if 0 <= day < 9 else None for s in schemas.SYMPTOMS[:-1]},
                }
            )
            seen = {c: valid[c] and rng.random() < 0.8 for c in schemas.CHANNELS}
            state = rng.gauss(0, 1)
            value = 60 + level + 0.8 * state + (3 if 0 <= day < 6 else 0) + rng.gauss(0, 1)
            week = day / 20
            panel.append(
                {
                    "user_id": user, "cohort": cohort, "study_date": date, "date_onset_merged": onset,
                    "days_since_symptoms_onset": day, "flu_period": "event" if -2 <= day <= 10 else "baseline",
                    "day_of_week": date.strftime("%A"), **{f"valid_user__{c}": valid[c] for c in schemas.CHANNELS},
                    **{f"valid_day__{c}": int(seen[c]) for c in schemas.CHANNELS},
                    **{f"{c}__observed": value if seen[c] else None for c in schemas.CHANNELS},
                    "week_L": week, "week_Q": week**2, "week_C": week**3,
                    "state__steps__scale1k": state, "state__heart": state, "state__sleep__scale60": state,
                }
            )

    def frame(rows, schema):
        return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in rows], schema)

    return {
        "people": frame(people, schemas.PARTICIPANTS).cache(), "events": frame(events, schemas.EVENTS_SURVEY).cache(),
        "days": frame(symptom_days, schemas.DAILY_SYMPTOMS).cache(), "panel": frame(panel, schemas.ACTIVITY_PANEL).cache(),
        "raw": (pd.DataFrame(people), pd.DataFrame(events), pd.DataFrame(symptom_days)),
    }


def test_demographics(tables):
    table = published.demographics(tables["people"])
    column = f"All {labels.COHORTS[0]} (N={N // 3})"
    assert column in table.columns
    got = {(r["variable"], r["value"]): r[column] for r in table.collect()}
    people = tables["raw"][0]
    mine = people[people["cohort"] == labels.COHORTS[0]]["education"].str.title().fillna("Unavailable")
    shares = mine.replace(labels.EDUCATION_NAMES).value_counts(normalize=True) * 100
    for answer, percent in shares.items():
        assert got[("education", answer)] == f"{round(percent, 1)}%"


def test_demographic_tests(tables):
    tests = published.demographic_tests(tables["people"]).collect()
    assert {r["variable"] for r in tests} == set(schemas.DEMOGRAPHICS)
    assert all(r["threshold"] == pytest.approx(0.01) and 0 <= r["p_value"] <= 1 for r in tests)
    assert published.demographic_tests(tables["people"], by_activity=True).count() == 5
    pairs = published.demographic_pairs(tables["people"], ["race", "age_group"])
    assert pairs.count() == 3 * (2 + 3)
    assert published.demographic_pairs(tables["people"], ["gender"], by_activity=True).count() == 3


def test_care(tables):
    table = published.care(tables["events"], tables["people"]).orderBy("question_position", "answer_position").collect()
    places = [r["value"] for r in table if r["variable"] == "Medical care location"]
    assert places == ["Urgent care facility", "Other", "Multiple locations", "Unavailable"]
    assert published.care_tests(tables["events"], tables["people"]).count() == 3
    assert published.care_pairs(tables["events"], tables["people"]).count() == 3 * (4 + 3 + 2)


def test_missing_care_location_stops(spark):
    rows = spark.createDataFrame([(None,)], "v string").select(study.care_location(F.col("v"), ["a"]))
    with pytest.raises(Exception, match="care location is missing"):
        rows.collect()


def test_symptoms(tables):
    table = published.symptoms(tables["events"], tables["people"], tables["days"])
    column = f"All {labels.COHORTS[0]} (N={N // 3})"
    rows = table.orderBy("position").collect()
    events = tables["raw"][1]
    mine = events[events["cohort"] == labels.COHORTS[0]]
    percent = {labels.SYMPTOM_NAMES[s]: 100 * mine[f"symptoms__{s}"].notnull().mean() for s in schemas.SYMPTOMS}
    assert [r["symptom"] for r in rows] == sorted(percent, key=lambda s: (-percent[s], [k for k, v in labels.SYMPTOM_NAMES.items() if v == s]))
    assert all(r[column] == f"{round(percent[r['symptom']], 1)}%" for r in rows)
    peak = {r["symptom"]: r[f"All {labels.COHORTS[0]} peak"] for r in rows}
    assert peak["Shortness of Breath"] == "NA"  # never reported on a day
    days = tables["raw"][2]
    cough = days[days["cohort"] == labels.COHORTS[0]].groupby("days_since_symptoms_onset")["daily_symp__cough"].sum()
    assert peak["Cough"] == str(cough.rolling(5, center=True).mean().idxmax())
    test = published.symptom_test(tables["events"], tables["people"]).collect()
    assert test[0]["dof"] == 24
    assert published.symptom_pairs(tables["events"], tables["people"]).count() == 3 * 13 * 2


def test_co_occurrence(tables):
    sets, totals = published.co_occurrence(tables["events"])
    events = tables["raw"][1]
    two = events[events["cohort"].isin(labels.COHORTS[:2])]
    flags = two[[f"symptoms__{s}" for s in schemas.SYMPTOMS]].notnull()
    flags.columns = schemas.SYMPTOMS
    top = set()
    for cohort in labels.COHORTS[:2]:
        counts = flags[two["cohort"] == cohort].sum()
        top |= set(sorted(counts.index, key=lambda s: (-counts[s], s))[:5])
    assert {r["symptom"] for r in totals.collect()} == top
    names = sorted(top)
    keys = flags[names].apply(lambda r: "+".join(n for n in names if r[n]), axis=1).value_counts()
    want = {k: n for k, n in keys.items() if n >= 0.02 * len(two)}
    assert {r["symptom_set"]: r["total"] for r in sets.collect()} == want


def test_conditions(tables):
    rows = published.conditions(tables["people"]).orderBy("position").collect()
    assert len(rows) == 36 and {"IBS or IBD", "Alzheimer's Disease", "Type 1 Diabetes"} <= {r["condition"] for r in rows}
    assert published.bowel_crosstab(tables["people"]).agg({"n_users": "sum"}).collect()[0][0] == N


def test_durations_and_prevalence(tables):
    events = tables["raw"][1]
    days = (pd.to_datetime(events["date_recovery_merged"]) - pd.to_datetime(events["date_onset_merged"])).dt.days
    want = days.groupby(events["cohort"]).median().to_dict()
    assert {r["cohort"]: r["median"] for r in published.duration_medians(tables["events"]).collect()} == want
    assert published.duration_tests(tables["events"]).count() == 3
    assert published.duration_density(tables["events"]).count() == 600
    assert published.daily_prevalence(tables["days"]).count() == 13 * 40


def test_activity(tables):
    fits = published.fit_activity(tables["panel"])
    slope = {r["model"]: r for r in fits.coefficients().filter("term like 'state%'").collect()}
    assert len(slope) == 6
    assert all(abs(r["estimate"] - 0.8) < 4 * r["std_error"] for r in slope.values())
    outputs = published.activity_outputs(tables["panel"], fits)
    rate = published.elevated_heart_rate(outputs).filter("threshold = 0").collect()
    ill = [r["share"] for r in rate if 3 <= r["days_since_symptoms_onset"] <= 5]
    well = [r["share"] for r in rate if r["days_since_symptoms_onset"] > 15]
    assert min(ill) > max(well)
    curves = published.excess_curves(outputs).collect()
    assert len(curves) == 2 * 3 * 31
    at = lambda lo, hi: [r["fit"] for r in curves if lo <= r["days_since_symptoms_onset"] <= hi]
    assert min(at(2, 3)) > 2.0 and max(abs(x) for x in at(12, 20)) < 1.2
    assert published.valid_users(tables["panel"]).count() == 9
    coverage = published.sensor_coverage(tables["panel"])
    assert {r[0] for r in coverage.select("channel").distinct().collect()} == {"RHR", "Steps", "Sleep"}
