"""Declared schemas of the four study datasets. Nothing is inferred at read time."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names of the study files.
SYMPTOMS = [
    "chills_shiver", "cough", "fatigue", "fever", "headache", "bodyache", "nasal",
    "sneezing", "sore_throat", "sweats", "anosmia", "chest_pain", "short_breath",
]
UNREPORTED_SYMPTOMS = ["other", "none", "no_symptoms"]
CHANNELS = ["steps", "heart", "sleep"]
DEMOGRAPHICS = ["gender", "education", "age_group", "bmi_group", "race"]
BOWEL_FLAGS = ["ibd", "ibs", "ibs_ibd"]
CONDITIONS = [
    "alzheimers", "anxiety", "arrhythmia", "arthritis", "asthma", "cancer", "chronic_pain", "copd",
    "coronary_heart_disease", "depression", "diabetes_t1", "diabetes_t2", "fibromyalgia", "gerd",
    "gestational_diabetes", "heart_attack", "heart_failure", "high_colesterol", "hypertension",
    "hypo_hyper_thyroidism", "insomnia", "lupus", "mental_health_not_depression_anxiety", "migraines",
    "multiple_sclerosis", "neurodegenerative", "obstructive_coronary_heart_disease", "osteoporosis", "pcos",
    "psoriasis", "restless_leg", "rheumatoid_arthritis", "seasonal_allergies", "sleep_apnea", "stroke",
]


def _fields(names: list[str], kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind, True) for name in names]


EVENTS_SURVEY = T.StructType(
    _fields(["user_id", "cohort"], T.StringType())
    + _fields([f"symptoms__{s}" for s in SYMPTOMS + UNREPORTED_SYMPTOMS], T.StringType())
    + _fields(["date_onset_merged", "date_recovery_merged"], T.DateType())
    + _fields(
        ["medical__sought_attention_where", "medical__hospitalized", "medical__medication"], T.StringType()
    )
)

DAILY_SYMPTOMS = T.StructType(
    _fields(["user_id", "cohort"], T.StringType())
    + _fields(["days_since_symptoms_onset"], T.IntegerType())
    + _fields([f"daily_symp__{s}" for s in SYMPTOMS + ["other"]], T.DoubleType())
)

PARTICIPANTS = T.StructType(
    _fields(["user_id", "cohort"], T.StringType())
    + _fields([f"valid_user__{c}" for c in CHANNELS], T.IntegerType())
    + _fields(DEMOGRAPHICS, T.StringType())
    + _fields(BOWEL_FLAGS + ["hs_completed"] + CONDITIONS, T.BooleanType())
)

ACTIVITY_PANEL = T.StructType(
    _fields(["user_id", "cohort"], T.StringType())
    + _fields(["study_date", "date_onset_merged"], T.DateType())
    + _fields(["days_since_symptoms_onset"], T.IntegerType())
    + _fields(["flu_period", "day_of_week"], T.StringType())
    + _fields([f"valid_user__{c}" for c in CHANNELS] + [f"valid_day__{c}" for c in CHANNELS], T.IntegerType())
    + _fields([f"{c}__observed" for c in CHANNELS], T.DoubleType())
    + _fields(["week_L", "week_Q", "week_C"], T.DoubleType())
    + _fields(["state__steps__scale1k", "state__heart", "state__sleep__scale60"], T.DoubleType())
    + _fields(["heart__imputed_z"], T.DoubleType())
)
