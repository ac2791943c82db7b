import pytest
from pyspark.sql import functions as F

from riskframe.operators import split
from tests.data import grouped


def test_holdout_is_group_disjoint_and_about_a_fifth(spark):
    df = grouped(spark)
    train, test = split.holdout_split(df, "y", "patient_nbr", 0.2, 42)
    split.assert_no_overlap(train, test, "patient_nbr")
    assert train.count() + test.count() == df.count()
    assert 0.12 < test.count() / df.count() < 0.28
    for side in (train, test):
        assert side.select("y").distinct().count() == 2


def test_overlap_raises_with_its_size(spark):
    left = spark.createDataFrame([(1,), (2,)], "g long")
    right = spark.createDataFrame([(2,), (3,)], "g long")
    with pytest.raises(split.GroupOverlap, match="1 groups"):
        split.assert_no_overlap(left, right, "g")


def test_three_way_parts_are_disjoint_and_complete(spark):
    df = grouped(spark, 400)
    parts = split.three_way_split(df, "y", "patient_nbr", 42)
    sets = [{r[0] for r in p.select("patient_nbr").distinct().collect()} for p in parts]
    assert not (sets[0] & sets[1] or sets[0] & sets[2] or sets[1] & sets[2])
    counts = [p.count() for p in parts]
    assert sum(counts) == df.count()
    assert [round(c / sum(counts), 1) for c in counts] == [0.6, 0.2, 0.2]


def fold_map(df):
    return {r.patient_nbr: r.fold for r in split.group_folds(df, "patient_nbr", "y", 5).collect()}


def test_folds_do_not_depend_on_partitioning(spark):
    df = grouped(spark)
    assert fold_map(df.repartition(1)) == fold_map(df.repartition(37))


def test_folds_depend_on_the_seed_and_are_even(spark):
    df = grouped(spark, 500)
    a = split.with_folds(df, "patient_nbr", "y", 5, 1)
    b = split.with_folds(df, "patient_nbr", "y", 5, 2)
    assert a.select("row_id", "fold").exceptAll(b.select("row_id", "fold")).count() > 0
    sizes = [(r.n, r.pos) for r in a.groupBy("fold").agg(F.count("*").alias("n"), F.sum("y").alias("pos")).collect()]
    assert len(sizes) == 5
    assert max(n for n, _ in sizes) - min(n for n, _ in sizes) <= 8
    assert max(p for _, p in sizes) - min(p for _, p in sizes) <= 3


def test_folds_with_one_group_holding_a_third(spark):
    df = grouped(spark, 200).withColumn(
        "patient_nbr", F.when(F.col("row_id") % 3 == 0, F.lit(-1)).otherwise(F.col("patient_nbr"))
    )
    plain = split.with_folds(df, "patient_nbr", "y", 5)
    split_hot = split.with_folds(df, "patient_nbr", "y", 5, slice_rows=10)
    assert plain.exceptAll(split_hot).count() == 0 and plain.count() == split_hot.count() == df.count()
    assert plain.groupBy("patient_nbr").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_fold_count_is_rounded():
    assert [split.folds_for_share(s) for s in (0.2, 0.25, 0.3)] == [5, 4, 3]


def test_hash_split_is_group_disjoint(spark):
    out = split.hash_split(grouped(spark), "patient_nbr", 5)
    assert out.groupBy("patient_nbr").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert out.select("fold").distinct().count() == 5
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_summary_counts_groups_on_both_sides(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", 2, 0), ("b", 3, 1)], "side string, g long, y int")
    rows = {r.side: r for r in split.split_summary(df, "side", "g", "y").collect()}
    assert rows["a"].n_rows == 2 and rows["a"].n_groups == 2 and rows["a"].positive_rate == 0.5
    assert rows["a"].common_groups == 1


@pytest.mark.parametrize("k", [0, 1, 50, 399, 10_000])
def test_fixed_sample_is_the_smallest_digests(spark, k):
    df = grouped(spark)
    got = {r.row_id for r in split.fixed_sample(df.repartition(13), k, "row_id").collect()}
    want = df.orderBy(split.key_digest(split.SEED, "row_id"), "row_id").limit(k)
    assert got == {r.row_id for r in want.collect()} and len(got) == min(k, df.count())


def test_three_way_split_equals_two_drafts(spark):
    df = grouped(spark)
    rest, conform = split.holdout_split(df, "y", "patient_nbr", 0.2)
    fit, calib = split.holdout_split(rest, "y", "patient_nbr", 0.25)
    ids = lambda t: {r.row_id for r in t.collect()}
    assert [ids(t) for t in split.three_way_split(df, "y", "patient_nbr")] == [ids(fit), ids(calib), ids(conform)]
