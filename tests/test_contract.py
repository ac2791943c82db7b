import pytest
from pyspark.sql import functions as F

from riskframe.operators import contract
from riskframe.operators.contract import ColumnRule, Contract, ContractViolation
from riskframe.plans.encounters import CONTRACT
from tests.data import raw


def found(df, rules=CONTRACT):
    return {(r.column_name, r.check_name, r.failure) for r in contract.contract_findings(df, rules).collect()}


def test_valid_rows_pass(spark):
    df = raw(spark, {}, {"encounter_id": 2, "readmitted": "<30"})
    assert contract.validate(df, CONTRACT).count() == 2


@pytest.mark.parametrize(
    "override, finding",
    [
        ({"gender": "X"}, ("gender", "isin", "X")),
        ({"age": "42"}, ("age", "isin", "42")),
        ({"time_in_hospital": 15}, ("time_in_hospital", "in_range", "15")),
        ({"num_procedures": -1}, ("num_procedures", "at_least", "-1")),
        ({"readmitted": None}, ("readmitted", "not_null", None)),
    ],
)
def test_bad_cell_is_found(spark, override, finding):
    df = raw(spark, override, {"encounter_id": 2})
    assert found(df) == {finding}
    with pytest.raises(ContractViolation):
        contract.validate(df, CONTRACT)


def test_repeated_key_is_found_for_every_row(spark):
    df = raw(spark, {}, {}, {"encounter_id": 2})
    rows = contract.contract_findings(df, CONTRACT).collect()
    assert [(r.column_name, r.check_name, r.failure) for r in rows] == [("encounter_id", "unique", "1")] * 2


def test_all_failures_are_reported_together(spark):
    df = raw(spark, {"gender": "X", "age": "42"}, {"time_in_hospital": 0})
    assert {c for c, _, _ in found(df)} == {"gender", "age", "time_in_hospital", "encounter_id"}


def test_race_may_be_missing_or_the_sentinel(spark):
    assert found(raw(spark, {"race": None}, {"encounter_id": 2, "race": "?"})) == set()


def test_missing_and_undeclared_columns(spark):
    df = raw(spark, {}).drop("age").withColumn("extra", F.lit(1))
    assert found(df) == {("age", "column_exists", None)}


def test_coercion_finds_what_does_not_cast(spark):
    df = spark.createDataFrame([("1", "3"), ("2", "x"), (None, "4")], "k string, v string")
    rules = Contract("k", (ColumnRule("k", "bigint"), ColumnRule("v", "int", at_least=4)))
    assert found(df, rules) == {("v", "coerce", "x"), ("v", "at_least", "3"), ("k", "not_null", None)}
    assert contract.coerce(df, rules).dtypes == [("k", "bigint"), ("v", "int")]


def test_first_findings_are_limited(spark):
    df = raw(spark, *[{"encounter_id": i, "gender": "X"} for i in range(30)])
    findings = contract.contract_findings(df, CONTRACT)
    assert contract.first_findings(findings).count() == 10 and findings.count() == 30


def test_split_by_contract(spark):
    good, bad = contract.split_by_contract(raw(spark, {}, {"encounter_id": 2, "age": None}), CONTRACT)
    assert [r.encounter_id for r in good.collect()] == [1]
    assert [(r.row_key, r.check_name) for r in bad.collect()] == [("2", "not_null")]
