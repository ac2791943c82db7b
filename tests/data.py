"""Seeded tables for the tests."""

import random

VALID = {
    "encounter_id": 1,
    "patient_nbr": 100,
    "gender": "Male",
    "age": "[50-60)",
    "race": "Caucasian",
    "time_in_hospital": 3,
    "num_lab_procedures": 40,
    "num_procedures": 1,
    "num_medications": 10,
    "number_outpatient": 0,
    "number_emergency": 0,
    "number_inpatient": 0,
    "number_diagnoses": 5,
    "change": "No",
    "diabetesMed": "Yes",
    "readmitted": "NO",
}
RAW_SCHEMA = (
    "encounter_id long, patient_nbr long, gender string, age string, race string, time_in_hospital int, "
    "num_lab_procedures int, num_procedures int, num_medications int, number_outpatient int, number_emergency int, "
    "number_inpatient int, number_diagnoses int, change string, diabetesMed string, readmitted string"
)


def raw(spark, *overrides, schema=RAW_SCHEMA):
    rows = [tuple({**VALID, **o}.values()) for o in overrides]
    return spark.createDataFrame(rows, schema)


def grouped(spark, n_groups=200, seed=0, rate=0.2):
    """Groups of one to three rows: row_id, patient_nbr, y."""
    rng = random.Random(seed)
    rows = []
    for g in range(n_groups):
        for _ in range(rng.randint(1, 3)):
            rows.append((len(rows), g, int(rng.random() < rate)))
    return spark.createDataFrame(rows, "row_id long, patient_nbr long, y int")


def signal_rows(n_groups=200, seed=0):
    rng = random.Random(seed)
    rows = []
    for g in range(n_groups):
        s = rng.gauss(0, 1)
        for _ in range(rng.randint(1, 3)):
            rows.append((len(rows), g, s + rng.gauss(0, 0.5), rng.choice("ABC"), int(s + rng.gauss(0, 0.5) > 0.7)))
    return rows


def signal(spark, n_groups=200, seed=0):
    """row_id, patient_nbr, num1, cat1, y with y depending on num1."""
    return spark.createDataFrame(
        signal_rows(n_groups, seed), "row_id long, patient_nbr long, num1 double, cat1 string, y int"
    )


def scores(n=500, seed=0, steps=20):
    """Tied scores with labels: (p, y)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        p = rng.randint(0, steps) / steps
        out.append((p, int(rng.random() < 0.2 + 0.5 * p)))
    return out
