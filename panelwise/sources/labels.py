"""Readable labels and row orders of the published tables.

Fixed values: they must equal the published tables' texts and are kept in natural order.
"""

from __future__ import annotations

COHORTS = ["COVID-19", "Non-COVID-19 Flu", "Pre-COVID-19 Flu"]

EDUCATION_NAMES = {
    "College Graduate, Associate Or Bachelor'S Degree": "College Degree",
    "Did Not Finish High School, No Diploma": "Did Not Finish High School",
    "Doctorate Degree, Md": "Doctorate Degree or MD",
    "High School Graduate, Diploma Or The Equivalent (For Example, Ged)": "High School Diploma or GED",
    "I'D Prefer Not To Answer": "Prefer Not To Answer",
}
AGE_ORDER = ["< 25", "25-34", "35-44", "45-54", "55 +"]
BMI_ORDER = ["< 18.5", "18.5 - 24.9", "25.0 - 29.9", "30 +"]
EDUCATION_ORDER = [
    "Did Not Finish High School", "High School Diploma or GED", "Some College, No Degree",
    "Trade/Technical/Vocational Training", "College Degree", "Graduate Degree", "Doctorate Degree or MD",
]
GENDER_ORDER = ["Female", "Male", "Other"]
RACE_ORDER = [
    "White / Caucasian", "Hispanic Or Latino", "Black Or African American", "Asian Or Pacific Islander",
    "American Indian Or Alaskan Native", "Prefer Not To Answer",
]
QUESTION_ORDER = ["gender", "race", "education", "age_group", "bmi_group"]

CARE_NAMES = {
    "primary care clinic e g family medicine internal medicine": "Primary care clinic",
    "urgent care facility": "Urgent care facility",
    "emergency room er": "Emergency room",
    "ear nose and throat otolaryngology clinic": "Ear, nose, and throat clinic",
    "infectious disease clinic": "Infectious disease clinic",
    "other": "Other",
    "multiple": "Multiple locations",
    "unavailable": "Unavailable",
}
CARE_ANSWER_NAMES = {
    "yes": "Yes", "no": "No", "dont know or remember": "Do not know/remember", "unavailable": "Unavailable",
}
CARE_QUESTION_NAMES = {
    "care_location__cleaned": "Medical care location",
    "medical__hospitalized": "Hospitalized",
    "medical__medication": "Prescribed medication",
}

SYMPTOM_NAMES = {
    "chills_shiver": "Chills or Shivering",
    "cough": "Cough",
    "fatigue": "Fatigue",
    "fever": "Fever",
    "headache": "Headache",
    "bodyache": "Body Muscle Ache",
    "nasal": "Nasal Congestion",
    "sneezing": "Sneezing",
    "sore_throat": "Sore Throat",
    "sweats": "Sweats",
    "anosmia": "Anosmia",
    "chest_pain": "Chest Pain/Pressure",
    "short_breath": "Shortness of Breath",
}

CONDITION_NAMES = {
    "Pcos": "PCOS",
    "Mental Health Not Depression Anxiety": "Mental Health (Excluding Depression/Anxiety)",
    "Gerd": "GERD",
    "Restless Leg": "Restless Leg Syndrome",
    "Hypo Hyper Thyroidism": "Hypo- or Hyperthyrodism",
    "High Colesterol": "High Cholesterol",
    "Ibs Ibd Collapsed": "IBS or IBD",
    "Alzheimers": "Alzheimer's Disease",
    "Copd": "COPD",
    "Diabetes T1": "Type 1 Diabetes",
    "Diabetes T2": "Type 2 Diabetes",
}

CHANNEL_NAMES = {"heart": "RHR", "steps": "Steps", "sleep": "Sleep"}
EXCESS_NAMES = {"steps": "Excess in Daily\nNumber of Steps", "sleep": "Excess in Daily\nSleep (minutes)"}
RANK_OFFSETS = {"COVID-19": 1000, "Non-COVID-19 Flu": 2000}
