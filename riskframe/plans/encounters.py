"""The default setting: hospital encounters and readmission within 30 days.

Fixed values of the public encounter table and of its clinical code groups.
"""

from __future__ import annotations

from riskframe.operators.clean import CleanRules
from riskframe.operators.contract import ColumnRule, Contract
from riskframe.operators.drift import NumericStress, OrdinalStress, OverwriteStress

# --- fixed values ------------------------------------------------------------

KEY = "encounter_id"
GROUP = "patient_nbr"
TARGET = "readmitted_30d"
MISSING_TOKEN = "?"

AGE_BUCKETS = [f"[{low}-{low + 10})" for low in range(0, 100, 10)]
GENDERS = ["Male", "Female", "Unknown/Invalid"]
RACES = ["Caucasian", "AfricanAmerican", "Asian", "Hispanic", "Other", "?"]
READMITTED = ["<30", ">30", "NO"]
CHANGE = ["Ch", "No"]
DIABETES_MED = ["Yes", "No"]

# Dispositions after which no readmission can follow.
TERMINAL_DISPOSITIONS = [11, 13, 14, 19, 20, 21]

NUMERIC_COLUMNS = [
    "time_in_hospital",
    "num_lab_procedures",
    "num_procedures",
    "num_medications",
    "number_outpatient",
    "number_emergency",
    "number_inpatient",
    "number_diagnoses",
]
DIAGNOSES = ["diag_1", "diag_2", "diag_3"]
SUBGROUPS = ["gender", "age", "race"]

# (group, low, high, high included, single further code)
DIAGNOSIS_RANGES = [
    ("Diabetes", 250, 251, False, None),
    ("Circulatory", 390, 459, True, 785),
    ("Respiratory", 460, 519, True, 786),
    ("Digestive", 520, 579, True, 787),
    ("Injury", 800, 999, True, None),
    ("Musculoskeletal", 710, 739, True, None),
    ("Genitourinary", 580, 629, True, 788),
    ("Neoplasms", 140, 239, True, None),
]
DIAGNOSIS_OTHER = "Other"
DIAGNOSIS_MISSING = "Missing"
DIAGNOSIS_OTHER_PREFIXES = ["V", "E"]

# --- the operators' settings -------------------------------------------------

CONTRACT = Contract(
    KEY,
    (
        ColumnRule(KEY, "bigint", unique=True),
        ColumnRule(GROUP, "bigint"),
        ColumnRule("gender", "string", allowed=GENDERS),
        ColumnRule("age", "string", allowed=AGE_BUCKETS),
        ColumnRule("race", "string", nullable=True, allowed=RACES),
        ColumnRule("time_in_hospital", "int", at_least=1, at_most=14),
        *(ColumnRule(c, "int", at_least=0) for c in NUMERIC_COLUMNS if c != "time_in_hospital"),
        ColumnRule("change", "string", allowed=CHANGE),
        ColumnRule("diabetesMed", "string", allowed=DIABETES_MED),
        ColumnRule("readmitted", "string", allowed=READMITTED),
    ),
)

CLEAN = CleanRules(
    token=MISSING_TOKEN,
    leak_column="discharge_disposition_id",
    leak_values=TERMINAL_DISPOSITIONS,
    invalid_column="gender",
    invalid_value="Unknown/Invalid",
    label_column="readmitted",
    positive_value="<30",
    target=TARGET,
    code_columns=DIAGNOSES,
    code_ranges=DIAGNOSIS_RANGES,
    code_other=DIAGNOSIS_OTHER,
    code_missing=DIAGNOSIS_MISSING,
    code_other_prefixes=DIAGNOSIS_OTHER_PREFIXES,
    dropped=["weight"],
)

STRESS = [
    NumericStress("time_in_hospital", add_max=3, low=1, high=14),
    NumericStress("num_lab_procedures", factor=0.2),
    NumericStress("num_procedures", add_max=2),
    NumericStress("num_medications", factor=0.3),
    NumericStress("number_outpatient", add_max=1),
    NumericStress("number_emergency", add_max=1),
    NumericStress("number_inpatient", add_max=1),
    NumericStress("number_diagnoses", add_max=2, low=1, high=16),
    OrdinalStress("age", AGE_BUCKETS, 0.25),
    OverwriteStress("A1Cresult", ">8", 0.3),
    OverwriteStress("medical_specialty", None, 0.2),
]
