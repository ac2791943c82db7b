"""Splits, folds and samples in which no group stands on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions.expressions import digest_number, draw_int, key_digest
from riskframe.operators.keyed import SLICE_ROWS, attach_by_key
from riskframe.operators.ordered import global_index, values_at_ranks
from riskframe.session import materialize

SEED = 42


class GroupOverlap(AssertionError):
    """Raised when groups appear on both sides of a split."""


def group_sizes(df: DataFrame, group: str, target: str, seed: int = SEED) -> DataFrame:
    """One written row per group: group, n, n_pos, _digest."""
    groups = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("bigint")).alias("n_pos")
    )
    digest = key_digest(seed, group).alias("_digest")
    return materialize(groups.select(group, "n", F.coalesce("n_pos", F.lit(0)).alias("n_pos"), digest), "groups")


def deal_groups(groups: DataFrame, group: str, k: int) -> DataFrame:
    """The groups with their fold.

    Groups are ordered by positives, size and a seeded digest, and dealt over
    the folds in snake order, so folds are close in size and in positive rate.
    """
    digest = F.col("_digest")
    # Falls along (n_pos desc, n desc, digest): rounding may merge neighbours
    # in that order but never swaps them.
    spread = -(F.col("n_pos").cast("double") * float(1 << 40) + F.col("n").cast("double")) + (
        digest_number(digest).cast("double") / float(1 << 32)
    )
    order = [F.desc("n_pos"), F.desc("n"), digest.asc(), F.asc_nulls_first(group)]
    indexed = global_index(groups, spread, order, "_index")
    place = F.pmod("_index", F.lit(k))
    backwards = F.pmod(F.floor(F.col("_index") / k), F.lit(2)) == 1
    fold = F.when(backwards, F.lit(k - 1) - place).otherwise(place).cast("int")
    return indexed.select(*groups.columns, fold.alias("fold"))


def group_folds(df: DataFrame, group: str, target: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """One row per group: group, n, n_pos, fold."""
    return deal_groups(group_sizes(df, group, target, seed), group, k).select(group, "n", "n_pos", "fold")


def with_folds(
    df: DataFrame,
    group: str,
    target: str,
    k: int = 5,
    seed: int = SEED,
    name: str = "fold",
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The table with each row's fold."""
    folds = materialize(group_folds(df, group, target, k, seed).drop("n_pos"), "folds")
    return attach_by_key(df, folds.withColumnRenamed("fold", name), group, "n", slice_rows)


def folds_for_share(test_size: float) -> int:
    """Number of folds whose first is about ``test_size`` (0.3 gives 3)."""
    return round(1 / test_size)


def holdout_split(
    df: DataFrame, target: str, group: str, test_size: float = 0.2, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """(train, test): fold 0 of ``round(1 / test_size)`` folds is the test side."""
    tagged = with_folds(df, group, target, folds_for_share(test_size), seed, "_side")
    return (
        tagged.where("_side <> 0").drop("_side"),
        tagged.where("_side = 0").drop("_side"),
    )


def three_way_split(
    df: DataFrame, target: str, group: str, seed: int = SEED
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fit, calib, conform): 60 / 20 / 20 of the rows, group-disjoint.

    Both drafts are dealt on the groups alone; the rows are joined once.
    """
    first = materialize(deal_groups(group_sizes(df, group, target, seed), group, folds_for_share(0.2)), "folds")
    rest = materialize(first.where("fold <> 0").drop("fold"), "groups")
    second = deal_groups(rest, group, folds_for_share(0.25))
    sides = first.where("fold = 0").select(group, "n", F.lit("conform").alias("_side")).unionByName(
        second.select(group, "n", F.when(F.col("fold") == 0, "calib").otherwise("fit").alias("_side"))
    )
    tagged = attach_by_key(df, materialize(sides, "sides"), group)
    return tuple(tagged.where(F.col("_side") == side).drop("_side") for side in ("fit", "calib", "conform"))


def hash_split(df: DataFrame, group: str, k: int = 5, seed: int = SEED, name: str = "fold") -> DataFrame:
    """Fold from the group's digest alone: no shuffle, fit for streams."""
    return df.withColumn(name, draw_int(seed, k, group))


def common_groups(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Groups present on both sides; each side is reduced to its groups first."""
    return left.select(group).distinct().intersect(right.select(group).distinct())


def assert_no_overlap(left: DataFrame, right: DataFrame, group: str) -> None:
    n = common_groups(left, right, group).count()
    if n:
        raise GroupOverlap(f"{n} groups stand on both sides of the split")


def split_summary(df: DataFrame, side: str, group: str, target: str) -> DataFrame:
    """Rows, groups and positive rate per side, and groups seen on several sides.

    Two levels of partial aggregation: per (side, group), then per side.
    """
    per_group = df.groupBy(side, group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("bigint")).alias("pos")
    )
    shared = per_group.groupBy(group).agg(F.count(F.lit(1)).alias("sides"))
    summary = per_group.groupBy(side).agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_groups"),
        (F.sum("pos") / F.sum("n")).alias("positive_rate"),
    )
    overlap = shared.agg(F.count_if(F.col("sides") > 1).alias("common_groups"))
    return summary.withColumn("common_groups", overlap.scalar())


def fixed_sample(df: DataFrame, k: int, *keys: str, seed: int = SEED) -> DataFrame:
    """k rows without replacement (all, if fewer), the same for any partitioning.

    The rows with the k smallest seeded digests: the k-th digest's number is
    found exactly, smaller ones stay, and only rows that share it are sorted.
    """
    if k <= 0:
        return df.limit(0)
    order = [key_digest(seed, *keys).asc(), *[F.asc(c) for c in keys]]
    numbers = df.withColumn("_draw", digest_number(key_digest(seed, *keys)).cast("double"))
    found, counts, _ = values_at_ranks(numbers, ["_draw"], lambda _s, _c, n: [min(k, n) - 1])
    n = counts["all", "_draw"]
    if not n:
        return df
    edge = found["all", "_draw"][min(k, n) - 1]
    below = numbers.where(F.col("_draw") < edge)
    at_edge = numbers.where(F.col("_draw") == edge).orderBy(*order).limit(max(0, min(k, n) - below.count()))
    return below.unionByName(at_edge).drop("_draw")
