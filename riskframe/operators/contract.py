"""Data contract: declared columns are checked and every violation is listed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.operators.keyed import attach_by_key
from riskframe.session import materialize

FINDINGS_SCHEMA = "row_key string, column_name string, check_name string, failure string"


@dataclass(frozen=True)
class ColumnRule:
    """What one column must satisfy."""

    name: str
    dtype: str
    nullable: bool = False
    unique: bool = False
    allowed: Sequence[str] | None = None
    at_least: float | None = None
    at_most: float | None = None


@dataclass(frozen=True)
class Contract:
    """Declared columns; columns not declared are let through unchecked."""

    key: str
    rules: Sequence[ColumnRule] = field(default_factory=tuple)


class ContractViolation(ValueError):
    """Raised after all findings were collected; carries the findings table."""

    def __init__(self, message: str, findings: DataFrame):
        super().__init__(message)
        self.findings = findings


def missing_columns(df: DataFrame, contract: Contract) -> list[str]:
    return [r.name for r in contract.rules if r.name not in df.columns]


def coerce(df: DataFrame, contract: Contract) -> DataFrame:
    """Declared columns in their declared types, NULL where the cast fails."""
    types = {r.name: r.dtype for r in contract.rules}
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def row_checks(df: DataFrame, rule: ColumnRule) -> list[tuple[str, Column]]:
    """(check, failed) for each check of a rule that one row can show."""
    raw = F.col(rule.name)
    value, checks = raw, []
    if df.schema[rule.name].dataType.simpleString() != rule.dtype:
        value = raw.try_cast(rule.dtype)
        checks.append(("coerce", raw.isNotNull() & value.isNull()))
    if not rule.nullable:
        checks.append(("not_null", raw.isNull()))
    if rule.allowed is not None:
        checks.append(("isin", ~value.isin(list(rule.allowed))))
    if rule.at_least is not None and rule.at_most is not None:
        checks.append(("in_range", ~value.between(rule.at_least, rule.at_most)))
    elif rule.at_least is not None:
        checks.append(("at_least", value < rule.at_least))
    elif rule.at_most is not None:
        checks.append(("at_most", value > rule.at_most))
    return checks


def _declared(df: DataFrame, contract: Contract) -> list[tuple[ColumnRule, str, Column]]:
    return [(r, name, failed) for r in contract.rules if r.name in df.columns for name, failed in row_checks(df, r)]


def _any_failed(checks: Sequence[tuple[ColumnRule, str, Column]]) -> Column:
    """True if a check failed; NULL or false if not."""
    return reduce(lambda a, b: a | b, [failed for _, _, failed in checks])


def row_findings(df: DataFrame, contract: Contract, only: Sequence[str] | None = None) -> DataFrame:
    """Failures a row shows on its own: one narrow scan, no shuffle.

    A struct is built for failed checks only. A filter on "any check failed"
    in front would read better but makes the optimizer rewrite that long
    condition for every alias of its columns.
    """
    checks = [c for c in _declared(df, contract) if only is None or c[1] in only]
    if not checks:
        return df.sparkSession.createDataFrame([], FINDINGS_SCHEMA)
    cells = [
        F.when(
            failed,
            F.struct(
                F.lit(rule.name).alias("column_name"),
                F.lit(name).alias("check_name"),
                F.col(rule.name).cast("string").alias("failure"),
            ),
        )
        for rule, name, failed in checks
    ]
    key = F.col(contract.key).cast("string") if contract.key in df.columns else F.lit(None).cast("string")
    return (
        df.select(key.alias("row_key"), F.explode(F.array_compact(F.array(*cells))).alias("f"))
        .select("row_key", "f.*")
    )


def duplicate_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Key values held by more than one row, with the number of rows.

    Rows are counted before the shuffle, so a key that fills a third of the
    table reaches the reducer as one row per map task.
    """
    return (
        df.where(F.col(columns[0]).isNotNull())
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where("n_rows > 1")
    )


def duplicate_rows(df: DataFrame, *columns: str) -> DataFrame:
    """All rows whose key is not unique; the rows of a hot key stay spread out."""
    return attach_by_key(df, materialize(duplicate_keys(df, *columns), "duplicates"), columns, "n_rows")


def unique_findings(df: DataFrame, contract: Contract) -> DataFrame:
    """One finding per row that shares its key.

    The rows are joined to the duplicate keys rather than unfolded from the
    counts, so that no single record has to stand for a hot key's rows.
    """
    out = None
    for rule in contract.rules:
        if not rule.unique or rule.name not in df.columns:
            continue
        value = F.col(rule.name).cast("string")
        found = duplicate_rows(df.select(*dict.fromkeys([contract.key, rule.name])), rule.name).select(
            F.col(contract.key).cast("string").alias("row_key"),
            F.lit(rule.name).alias("column_name"),
            F.lit("unique").alias("check_name"),
            value.alias("failure"),
        )
        out = found if out is None else out.unionByName(found)
    return out if out is not None else df.sparkSession.createDataFrame([], FINDINGS_SCHEMA)


def absent_findings(df: DataFrame, contract: Contract) -> DataFrame:
    """Declared columns the table does not have (schema only, no scan)."""
    rows = [(None, c, "column_exists", None) for c in missing_columns(df, contract)]
    return df.sparkSession.createDataFrame(rows, FINDINGS_SCHEMA)


def contract_findings(df: DataFrame, contract: Contract) -> DataFrame:
    """Every failure of every check: row_key, column_name, check_name, failure."""
    found = row_findings(df, contract)
    if any(r.unique and r.name in df.columns for r in contract.rules):
        found = found.unionByName(unique_findings(df, contract))
    if missing_columns(df, contract):
        found = found.unionByName(absent_findings(df, contract))
    return found


def first_findings(findings: DataFrame, n: int = 10) -> DataFrame:
    return findings.orderBy("column_name", "check_name", "row_key", "failure").limit(n)


def validate(df: DataFrame, contract: Contract, show: int = 10) -> DataFrame:
    """The table in its declared types, or ``ContractViolation`` with all findings."""
    findings = contract_findings(df, contract)
    sample = first_findings(findings, show).collect()
    if sample:
        lines = "\n".join(f"  {r.column_name}: {r.check_name} ({r.failure!r}, row {r.row_key})" for r in sample)
        raise ContractViolation(f"the table breaks its contract; first findings:\n{lines}", findings)
    return coerce(df, contract)


def split_by_contract(df: DataFrame, contract: Contract) -> tuple[DataFrame, DataFrame]:
    """Rows that pass their own checks (in declared types), and row findings."""
    checks = _declared(df, contract)
    passed = ~F.coalesce(_any_failed(checks), F.lit(False)) if checks else F.lit(True)
    return coerce(df.where(passed), contract), row_findings(df, contract)
