"""Queries on splits, folds and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.operators import split
from riskframe.plans.standins import digest_number_sql, digest_sql, rounded, sql, view

QUERIES: dict = {}
ORACLES: dict = {}

SEED = split.SEED


def folds_sql(source: str, k: int, seed: int = SEED, group: str = "patient_nbr", label: str = "y") -> str:
    """Groups of ``source`` dealt over k folds, with a whole-table row number."""
    return f"""SELECT {group}, n, n_pos,
        CAST(CASE WHEN (i // {k}) % 2 = 1 THEN {k - 1} - i % {k} ELSE i % {k} END AS INT) AS fold
    FROM (SELECT *, row_number() OVER (ORDER BY n_pos DESC, n DESC, {digest_sql(seed, group)}, {group}) - 1 AS i
          FROM (SELECT {group}, count(*) AS n, CAST(sum({label}) AS BIGINT) AS n_pos FROM {source} GROUP BY {group}))"""


def scored(spark, d) -> DataFrame:
    return view(spark, d, "scored").select("encounter_id", "patient_nbr", "y")


QUERIES["group_kfold"] = lambda spark, d: split.group_folds(scored(spark, d), "patient_nbr", "y", 5)
ORACLES["group_kfold"] = sql(folds_sql("scored", 5), "scored")


def split_holdout(spark, d) -> DataFrame:
    train, test = split.holdout_split(scored(spark, d), "y", "patient_nbr", 0.3)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


QUERIES["split_holdout"] = split_holdout
ORACLES["split_holdout"] = sql(
    f"""SELECT encounter_id, s.patient_nbr, y, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS side
    FROM scored AS s JOIN ({folds_sql('scored', 3)}) AS f ON s.patient_nbr = f.patient_nbr""",
    "scored",
)


def split_three_way(spark, d) -> DataFrame:
    parts = zip(("fit", "calib", "conform"), split.three_way_split(scored(spark, d), "y", "patient_nbr"))
    out = None
    for name, part in parts:
        part = part.withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES["split_three_way"] = split_three_way
ORACLES["split_three_way"] = sql(
    f"""WITH first AS ({folds_sql('scored', 5)}),
    rest AS (SELECT * FROM scored WHERE patient_nbr IN (SELECT patient_nbr FROM first WHERE fold <> 0)),
    second AS ({folds_sql('rest', 4)})
    SELECT encounter_id, s.patient_nbr, y,
           CASE WHEN first.fold = 0 THEN 'conform' WHEN second.fold = 0 THEN 'calib' ELSE 'fit' END AS part
    FROM scored AS s JOIN first ON s.patient_nbr = first.patient_nbr
    LEFT JOIN second ON s.patient_nbr = second.patient_nbr""",
    "scored",
)
QUERIES["split_hash"] = lambda spark, d: split.hash_split(scored(spark, d), "patient_nbr", 5)
ORACLES["split_hash"] = sql(
    f"SELECT *, CAST({digest_number_sql(SEED, 'patient_nbr')} % 5 AS INT) AS fold "
    "FROM (SELECT encounter_id, patient_nbr, y FROM scored)",
    "scored",
)
QUERIES["split_overlap"] = lambda spark, d: split.common_groups(
    scored(spark, d).where("y = 1"), scored(spark, d).where("y = 0"), "patient_nbr"
)
ORACLES["split_overlap"] = sql(
    "SELECT patient_nbr FROM scored WHERE y = 1 INTERSECT SELECT patient_nbr FROM scored WHERE y = 0", "scored"
)


def split_summary(spark, d) -> DataFrame:
    tagged = split.with_folds(scored(spark, d), "patient_nbr", "y", 5)
    sides = tagged.withColumn("side", F.when(F.col("fold") == 0, "test").otherwise("train"))
    return rounded(split.split_summary(sides, "side", "patient_nbr", "y"))


QUERIES["split_summary"] = split_summary
ORACLES["split_summary"] = sql(
    f"""SELECT CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS side, count(*) AS n_rows,
    count(DISTINCT s.patient_nbr) AS n_groups, round(avg(y), 6) AS positive_rate, CAST(0 AS BIGINT) AS common_groups
    FROM scored AS s JOIN ({folds_sql('scored', 5)}) AS f ON s.patient_nbr = f.patient_nbr GROUP BY 1""",
    "scored",
)
QUERIES["sample_fixed"] = lambda spark, d: split.fixed_sample(scored(spark, d), 2000, "encounter_id")
ORACLES["sample_fixed"] = sql(
    f"""SELECT encounter_id, patient_nbr, y FROM scored
    ORDER BY {digest_sql(SEED, 'encounter_id')}, encounter_id LIMIT 2000""",
    "scored",
)
