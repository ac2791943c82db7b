"""Feature preparation fitted on training rows only.

Statistics are gathered for several row sets (the folds' training sides) in
the same passes; the fitted result is a ``PipelineModel`` of built-in stages,
so it runs in the JVM and is saved and loaded like any other model.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark import keyword_only
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.operators.keyed import attach_by_key
from riskframe.operators.ordered import quantiles_with
from riskframe.session import materialize, write_shared

MISSING_LEVEL = "Missing"
INFREQUENT = "infrequent"
MIN_FREQUENCY = 10

# Rare levels up to this number travel with the indexer; more are joined.
MAX_INDEXED_RARE = 1_000_000


@dataclass(frozen=True)
class FeatureSpec:
    """Feature columns in table order."""

    numeric: list[str]
    categorical: list[str]
    constant: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [*self.numeric, *self.categorical]


# --- which columns are features ----------------------------------------------


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, is_constant (one level, the missing level counted).

    Smallest and largest value and the missing count of all columns fit in one
    aggregate row; no distinct count is needed.
    """
    flags = []
    for c in columns:
        missing = F.count_if(F.col(c).isNull())
        same = F.min(c).eqNullSafe(F.max(c)) & ((missing == 0) | (missing == F.count(F.lit(1))))
        flags.append(same.alias(c))
    return df.agg(*flags).unpivot([], list(columns), "column_name", "is_constant")


def feature_roles(df: DataFrame, target: str, numeric: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """column_name, place, role (numeric, categorical or constant)."""
    columns = [c for c in df.columns if c != target and c not in set(ids)]
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column_name"))
    role = (
        F.when(F.col("is_constant"), "constant")
        .when(F.col("column_name").isin(list(numeric)), "numeric")
        .otherwise("categorical")
    )
    return constant_columns(df, columns).select("column_name", place.cast("int").alias("place"), role.alias("role"))


def feature_spec(df: DataFrame, target: str, numeric: Sequence[str], ids: Sequence[str]) -> FeatureSpec:
    rows = feature_roles(df, target, numeric, ids).orderBy("place").collect()  # one row per column

    def having(role: str) -> list[str]:
        return [r["column_name"] for r in rows if r["role"] == role]

    return FeatureSpec(having("numeric"), having("categorical"), having("constant"))


# --- statistics of the training rows -----------------------------------------


def as_level(c: str) -> Column:
    """Category text of a column, codes included; missing is a level."""
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL))


def level_counts(df: DataFrame, categorical: Sequence[str], sets: Mapping[str, Column] | None = None) -> DataFrame:
    """column_name, level and the rows of each set: one partial aggregation."""
    sets = dict(sets or {"n": F.lit(True)})
    cells = [F.struct(F.lit(c).alias("column_name"), as_level(c).alias("level")) for c in categorical]
    flags = {s: f"_s{i}" for i, s in enumerate(sets)}
    return (
        df.select(*[p.alias(flags[s]) for s, p in sets.items()], F.explode(F.array(*cells)).alias("cell"))
        .groupBy("cell.column_name", "cell.level")
        .agg(*[F.count_if(F.col(flags[s])).alias(s) for s in sets])
    )


def onehot_vocabulary(df: DataFrame, categorical: Sequence[str], min_frequency: int = MIN_FREQUENCY) -> DataFrame:
    """column_name, level, n, slot: rare levels share one slot per column."""
    slot = F.when(F.col("n") >= min_frequency, F.col("level")).otherwise(INFREQUENT)
    return level_counts(df, categorical).withColumn("slot", F.concat("column_name", F.lit("_"), slot))


def onehot_long(df: DataFrame, key: str, categorical: Sequence[str], vocabulary: DataFrame) -> DataFrame:
    """One-hot encoding as rows (key, feature, value); unseen levels have none.

    Levels that fill a large part of the vocabulary's rows are joined by
    broadcast, the others as the optimizer sees fit for the vocabulary's size.
    """
    cells = [F.struct(F.lit(c).alias("column_name"), as_level(c).alias("level")) for c in categorical]
    rows = df.select(key, F.explode(F.array(*cells)).alias("cell")).select(key, "cell.*")
    coded = attach_by_key(rows, vocabulary, ["column_name", "level"], "n")
    return coded.select(key, F.col("slot").alias("feature"), F.lit(1.0).alias("value"))


@dataclass(frozen=True)
class NumericStats:
    median: float
    mean: float
    std: float


@dataclass(frozen=True)
class LevelStats:
    frequent: list[str]
    rare: list[str]
    n_rare: int


@dataclass(frozen=True)
class PrepStats:
    numeric: dict[str, NumericStats]
    levels: dict[str, LevelStats]
    rare_table: DataFrame | None = None


def numeric_stats(
    df: DataFrame, numeric: Sequence[str], sets: Mapping[str, Column] | None = None
) -> dict[str, dict[str, NumericStats]]:
    """Median of the non-missing values; mean and population deviation after
    the median is filled in. A deviation of zero counts as one."""
    sets = dict(sets or {"all": F.lit(True)})
    if not numeric:
        return {s: {} for s in sets}
    moments = []
    for inside in sets.values():
        for c in numeric:
            value = F.when(inside, F.nanvl(F.col(c).cast("double"), F.lit(None)))
            moments += [F.count_if(inside), F.count(value), F.avg(value), F.var_pop(value)]
    medians, row = quantiles_with(df, numeric, [0.5], sets, moments)
    found = iter(row)
    return {
        s: {c: filled_moments(medians[s, c][0], next(found), next(found), next(found), next(found)) for c in numeric}
        for s in sets
    }


def filled_moments(median, n: int, present: int, mean, var) -> NumericStats:
    """Moments of n values of which the missing ones took the median."""
    if not present:
        return NumericStats(0.0, 0.0, 1.0)
    share = (n - present) / n
    spread = (1 - share) * (var + share * (median - mean) ** 2)
    return NumericStats(median, mean + share * (median - mean), math.sqrt(spread) or 1.0)


def category_stats(
    df: DataFrame,
    categorical: Sequence[str],
    sets: Mapping[str, Column] | None = None,
    min_frequency: int = MIN_FREQUENCY,
    max_width: int | None = None,
    max_indexed_rare: int = MAX_INDEXED_RARE,
) -> dict[str, tuple[dict[str, LevelStats], DataFrame | None]]:
    """Frequent and rare levels per set and column.

    The one-hot width is also the length of the model's coefficient vector, which
    the driver and every task hold: a caller who knows their memory can bound it
    by ``max_width``, checked on the written level table before anything is
    collected; ``onehot_long`` has no such vector. Rare levels beyond the limit stay in a table and are joined when encoding.
    """
    sets = dict(sets or {"all": F.lit(True)})
    if not categorical:
        return {s: ({}, None) for s in sets}
    names = {s: f"n{i}" for i, s in enumerate(sets)}
    counts = materialize(level_counts(df, categorical, {names[s]: p for s, p in sets.items()}), "levels")
    sizes = counts.groupBy("column_name").agg(
        *[F.count_if(F.col(n) >= min_frequency).alias(f"f_{n}") for n in names.values()],
        *[F.count_if((F.col(n) > 0) & (F.col(n) < min_frequency)).alias(f"r_{n}") for n in names.values()],
    )
    per_column = {r["column_name"]: r for r in sizes.collect()}  # one row per column
    out = {}
    for s, n in names.items():
        width = sum(r[f"f_{n}"] for r in per_column.values())
        if max_width is not None and width > max_width:
            raise ValueError(
                f"{width} levels reach min_frequency={min_frequency}; a model that wide does not fit "
                "in a task. Raise min_frequency or leave out the widest columns."
            )
        rare_total = sum(r[f"r_{n}"] for r in per_column.values())
        indexed = rare_total <= max_indexed_rare
        kept = counts.where(F.col(n) > 0) if indexed else counts.where(F.col(n) >= min_frequency)
        levels = {c: ([], []) for c in categorical}
        for r in kept.select("column_name", "level", n).collect():  # size checked above
            levels[r["column_name"]][0 if r[n] >= min_frequency else 1].append(r["level"])
        stats = {
            c: LevelStats(sorted(f), sorted(r), per_column[c][f"r_{n}"] if c in per_column else 0)
            for c, (f, r) in levels.items()
        }
        rare = None
        if not indexed:
            rare = counts.where((F.col(n) > 0) & (F.col(n) < min_frequency)).select("column_name", "level")
        out[s] = (stats, rare)
    return out


def fit_stats(
    df: DataFrame, spec: FeatureSpec, sets: Mapping[str, Column] | None = None, **limits
) -> dict[str, PrepStats]:
    """Statistics of each row set, all sets in the same passes over the table."""
    numbers = numeric_stats(df, spec.numeric, sets)
    categories = category_stats(df, spec.categorical, sets, **limits)
    return {s: PrepStats(numbers[s], *categories[s]) for s in numbers}


def impute_and_scale(df: DataFrame, stats: Mapping[str, NumericStats]) -> DataFrame:
    """Replace numeric columns by their filled and standardised values."""
    changed = {c: (F.coalesce(F.col(c).cast("double"), F.lit(s.median)) - s.mean) / s.std for c, s in stats.items()}
    return df.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in df.columns])


# --- the fitted encoder ------------------------------------------------------


class RareLevelJoin(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Marks rows whose level is in a stored table of rare levels.

    Used when the rare levels are too many to travel with the model. Levels
    the indexer already knows get a key of their own, spread by the row's
    hash; all others, which may be new and frequent, are dealt over SALTS
    copies of the stored levels. So no level gathers in one task.
    """

    SALTS = 64

    path = Param(Params._dummy(), "path", "folder of the rare levels", TypeConverters.toString)
    column = Param(Params._dummy(), "column", "column the levels belong to", TypeConverters.toString)
    levelCol = Param(Params._dummy(), "levelCol", "level text", TypeConverters.toString)
    indexCol = Param(Params._dummy(), "indexCol", "index of the level", TypeConverters.toString)
    known = Param(Params._dummy(), "known", "number of indexed levels", TypeConverters.toInt)
    outputCol = Param(Params._dummy(), "outputCol", "flag column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, path=None, column=None, levelCol=None, indexCol=None, known=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        value = self.getOrDefault
        rare = (
            df.sparkSession.read.parquet(value(self.path))
            .where(F.col("column_name") == value(self.column))
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(self.SALTS - 1))))
            .select(F.concat("_salt", F.lit("l"), "level").alias("_level"), F.lit(True).alias(value(self.outputCol)))
        )
        own = F.xxhash64(F.monotonically_increasing_id())
        key = F.when(F.col(value(self.indexCol)) < value(self.known), F.concat(F.lit("k"), own.cast("string"))).otherwise(
            F.concat(F.pmod(own, F.lit(self.SALTS)).cast("string"), F.lit("l"), F.col(value(self.levelCol)))
        )
        return df.withColumn("_key", key).join(rare, F.col("_key") == F.col("_level"), "left").drop("_key", "_level")


def _quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def feature_names(spec: FeatureSpec, stats: PrepStats) -> list[str]:
    """Names of the vector's entries: numeric columns, then column_level."""
    names = list(spec.numeric)
    for c in spec.categorical:
        s = stats.levels[c]
        names += [f"{c}_{v}" for v in s.frequent] + ([f"{c}_{INFREQUENT}"] if s.n_rare else [])
    return names


def encoder(spark: SparkSession, spec: FeatureSpec, stats: PrepStats) -> PipelineModel:
    """Built-in stages that turn the feature columns into ``features``."""
    stages: list = []
    numbers = [f"_num{i}" for i in range(len(spec.numeric))]
    levels = [f"_cat{i}" for i in range(len(spec.categorical))]
    indexes = [f"_idx{i}" for i in range(len(spec.categorical))]
    slots = [f"_slot{i}" for i in range(len(spec.categorical))]
    hots = [f"_hot{i}" for i in range(len(spec.categorical))]

    parts = []
    for c, out in zip(spec.numeric, numbers):
        s = stats.numeric[c]
        parts.append(
            f"(coalesce(try_cast({_quoted(c)} AS DOUBLE), {s.median!r}D) - {s.mean!r}D) / {s.std!r}D AS {out}"
        )
    for c, out in zip(spec.categorical, levels):
        parts.append(f"coalesce(CAST({_quoted(c)} AS STRING), '{MISSING_LEVEL}') AS {out}")
    stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__"))

    if spec.categorical:
        known = [stats.levels[c] for c in spec.categorical]
        stages.append(
            StringIndexerModel.from_arrays_of_labels(
                [s.frequent + s.rare or [MISSING_LEVEL] for s in known], levels, indexes, handleInvalid="keep"
            )
        )
        cases, widths = [], []
        path = write_shared(stats.rare_table, "rare") if stats.rare_table is not None else None
        for i, (c, s) in enumerate(zip(spec.categorical, known)):
            f, extra = len(s.frequent), 1 if s.n_rare else 0
            is_rare = f"{indexes[i]} < {f + len(s.rare)}"
            if path and s.n_rare:
                stages.append(
                    RareLevelJoin(
                        path=path, column=c, levelCol=levels[i], indexCol=indexes[i], known=f, outputCol=f"_rare{i}"
                    )
                )
                is_rare = f"coalesce(_rare{i}, false)"
            cases.append(
                f"CASE WHEN {indexes[i]} < {f} THEN {indexes[i]} WHEN {is_rare} THEN {f}D "
                f"ELSE {f + extra}D END AS {slots[i]}"
            )
            widths.append(f + extra + 1)  # the last one stands for unseen levels and is dropped
        stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(cases)} FROM __THIS__"))
        shape = spark.range(1).select(
            *[
                F.lit(0.0).alias(c, metadata={"ml_attr": {"type": "nominal", "num_vals": max(w, 2)}})
                for c, w in zip(slots, widths)
            ]
        )
        stages.append(OneHotEncoder(inputCols=slots, outputCols=hots, dropLast=True).fit(shape))
    stages.append(VectorAssembler(inputCols=[*numbers, *hots], outputCol="features"))
    return PipelineModel(stages)


class TabularPrep(Estimator):
    """Estimator form: fits the statistics and returns the encoder."""

    def __init__(self, spec: FeatureSpec, min_frequency: int = MIN_FREQUENCY):
        super().__init__()
        self.spec = spec
        self.min_frequency = min_frequency

    def _fit(self, df: DataFrame) -> PipelineModel:
        stats = fit_stats(df, self.spec, min_frequency=self.min_frequency)["all"]
        return encoder(df.sparkSession, self.spec, stats)


def sparse_parts(features: str = "features") -> tuple[Column, Column, Column]:
    """(width, indices, values) of a vector column, dense or sparse."""
    v = F.unwrap_udt(features)
    width = F.coalesce(v["size"], F.size(v["values"]))
    indices = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    return width, indices, v["values"]


def encoded_check(model: PipelineModel, sides: Mapping[str, DataFrame]) -> DataFrame:
    """Per side: rows, narrowest and widest vector, values that are not numbers."""
    width, _, values = sparse_parts()
    out = None
    for name, df in sides.items():
        part = (
            model.transform(df)
            .select(F.lit(name).alias("side"), width.alias("w"), F.size(F.filter(values, F.isnan)).alias("bad"))
            .groupBy("side")
            .agg(
                F.count(F.lit(1)).alias("n_rows"),
                F.min("w").alias("min_width"),
                F.max("w").alias("max_width"),
                F.sum("bad").alias("n_nan"),
            )
        )
        out = part if out is None else out.unionByName(part)
    return out


def training_sets(fold: str, k: int) -> dict[str, Column]:
    """Training side of each fold as a row predicate."""
    return {str(i): F.col(fold) != i for i in range(k)}


def fold_stats(df: DataFrame, fold: str, k: int, numeric: Sequence[str]) -> DataFrame:
    """fold, column_name, median, mean, std of each fold's training side."""
    stats = numeric_stats(df, numeric, training_sets(fold, k))
    rows = [(int(s), c, v.median, v.mean, v.std) for s, cols in stats.items() for c, v in cols.items()]
    return df.sparkSession.createDataFrame(rows, "fold int, column_name string, median double, mean double, std double")
