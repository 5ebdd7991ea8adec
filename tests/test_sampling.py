"""Exact sampling against brute force; stratum count arithmetic."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.functions import hash_order
from faultline.operators import sampling


def strata_frame(spark, sizes):
    rows = [(s, i) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "strt int, k int")


def test_counts_truncation_and_cv(spark):
    df = strata_frame(spark, {2: 31, 1: 100, 0: 1000})
    p = {0: 0.1, 1: 0.6, 2: 0.3}
    got = {r.strt: r.n for r in sampling.undersample_counts(df, "strt", p).collect()}
    assert got == {2: int(0.3 * 31 / 0.3), 1: int(min(0.6 * 31 / 0.3, 100)), 0: int(min(0.1 * 31 / 0.3, 1000))}
    assert got[2] == 30                      # the float formula loses one anchor row
    cv = {r.strt: r.n for r in sampling.undersample_counts(df, "strt", p, cv=True).collect()}
    assert cv == {k: int(v * 0.8) for k, v in got.items()}


def test_take_smallest_equals_row_number(spark):
    df = strata_frame(spark, {0: 5000, 1: 300, 2: 7})
    counts = spark.createDataFrame([(0, 1234), (1, 300), (2, 50)], "strt int, n long")
    got = sampling.take_smallest(df, ["strt"], hash_order(9, "k"), counts, ties=["k"])
    w = Window.partitionBy("strt").orderBy(hash_order(9, "k"))
    want = (df.withColumn("rn", F.row_number().over(w)).join(counts, "strt")
            .where(F.col("rn") <= F.col("n")).select("strt", "k"))
    assert sorted(map(tuple, got.select("strt", "k").collect())) == sorted(map(tuple, want.collect()))
    sizes = {r.strt: r["count"] for r in got.groupBy("strt").count().collect()}
    assert sizes == {0: 1234, 1: 300, 2: 7}


def test_bags_exact_and_disjoint_within_bag(spark):
    df = strata_frame(spark, {0: 3000, 1: 800, 2: 40})
    counts = sampling.undersample_counts(df, "strt", {0: 0.1, 1: 0.6, 2: 0.3})
    b = sampling.bag_membership(df, "strt", counts, 4, 42, ["k"])
    n = {r.strt: r.n for r in counts.collect()}
    sizes = {(r.bag, r.strt): r["count"] for r in b.groupBy("bag", "strt").count().collect()}
    assert all(sizes[(bag, s)] == n[s] for bag in range(4) for s in n)
    assert b.select("bag", "strt", "k").distinct().count() == b.count()


def test_split_is_stable_and_near_share(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = sampling.train_test_split(df, ["k"], 0.2, 42)
    share = a.where(F.col("split") == "test").count() / 20000
    assert abs(share - 0.2) < 0.015
    b = sampling.train_test_split(df.repartition(7), ["k"], 0.2, 42)
    assert a.where("split = 'test'").select("k").subtract(b.where("split = 'test'").select("k")).count() == 0


def test_a_stratum_without_proportion_fails(spark):
    df = spark.createDataFrame([(0,)] * 50 + [(1,)] * 20 + [(2,)] * 5, "strt int")
    for listed in ({0: 0.5, 2: 0.5}, {0: 0.5, 1: 0.5}):
        with pytest.raises(Exception, match="no proportion is given for stratum"):
            sampling.undersample_counts(df, "strt", listed).collect()


def test_rows_with_a_null_key_part_are_sampled(spark):
    df = spark.createDataFrame([(None if i % 4 == 0 else f"d{i}", i, 0) for i in range(100)], "device string, date int, strt int")
    quota = spark.createDataFrame([(0, 100, 33)], "strt int, n_rows long, n long")
    assert sampling.stratified_undersample(df, "strt", quota, 1, ["device", "date"]).count() == 33
    sides = {(r.device is None, r.split) for r in sampling.train_test_split(df, ["device", "date"]).collect()}
    assert (True, "test") in sides and (True, "train") in sides
    bags = sampling.bag_membership(df, "strt", quota, 2, 1, ["device", "date"])
    assert [r["count"] for r in bags.groupBy("bag").count().collect()] == [33, 33]


def test_rug_takes_any_number_of_classes(spark):
    df = spark.createDataFrame([(i, i // 3, float(i)) for i in range(3600)], "k int, y int, m1 double")
    assert sampling.rug_sample(df, ["m1"], "y", 2, 1, ["k"]).count() == 2400


def test_split_has_the_exact_size(spark):
    import math
    for n in (0, 1, 4, 5, 1003):
        df = spark.range(n).withColumnRenamed("id", "k")
        got = sampling.train_test_split(df, ["k"], 0.2, 7)
        assert got.where("split = 'test'").count() == math.ceil(0.2 * n) and got.count() == n
    low = sampling.smallest_share(spark.range(1003), sampling.hash_order(7, "id"), 0.2)
    want = sorted(r[0] for r in spark.range(1003).select(sampling.hash_order(7, "id")).collect())
    assert low == want[math.ceil(0.2 * 1003) - 1]


def test_nothing_runs_before_bags_are_asked_for(spark):
    from pyspark.sql import functions as F
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 3).cast("int").alias("strt"),
                                 F.when(F.col("id") < 0, 1).otherwise(F.raise_error(F.lit("evaluated")).cast("int")).alias("x"))
    counts = sampling.undersample_counts(df.drop("x"), "strt", {0: 0.3, 1: 0.3, 2: 0.4})
    sampling.bag_membership(df, "strt", counts, 3, 1, ["k"])
