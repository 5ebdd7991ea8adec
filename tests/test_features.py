"""Hand tables for the per-device windows, rank, filter and zero mark."""

import datetime as dt

from pyspark.sql import functions as F

from faultline.operators import clean, features
from faultline.operators.rank import min_rank, rank_table
from faultline.schema import PanelSchema

D = dt.date


def lag_table(spark):
    rows = [  # device, date, m
        ("A", D(2024, 1, 1), 0), ("A", D(2024, 1, 2), 0), ("A", D(2024, 1, 4), 5),
        ("A", D(2024, 1, 5), 0), ("A", D(2024, 1, 6), None), ("A", D(2024, 1, 7), 4),
        ("B", D(2024, 1, 3), 7),                      # one-row device
        ("C", D(2024, 1, 1), 2), ("C", D(2024, 1, 3), 3),
    ]
    df = spark.createDataFrame(rows, "device string, date date, m1 long").withColumn("failure", F.lit(0))
    return df, PanelSchema(num_cols=("m1",))


def test_change_switch_elapsed(spark):
    df, schema = lag_table(spark)
    out, _ = features.change_metrics(df, schema, drop=())
    out, _ = features.switch_metrics(out, schema)
    got = {(r.device, r.date.day): (r.elapsed, r.ch1, r.sw1) for r in out.collect()}
    # first row 0; 0->0 undefined -> 0; 0->5 infinite -> 0; 5->0 -> 1; null carries 0 forward;
    # 0 (carried) -> 4 infinite -> 0
    assert got[("A", 1)] == (1, 0.0, 0)
    assert got[("A", 2)] == (1, 0.0, 0)
    assert got[("A", 4)] == (2, 0.0, 1)
    assert got[("A", 5)] == (1, 1.0, -1)
    assert got[("A", 6)] == (1, 0.0, 1)      # NULL counts as "on" (NULL != 0)
    assert got[("A", 7)] == (1, 0.0, 0)
    assert got[("B", 3)] == (None, 0.0, 0)   # device-local back-fill leaves one-row devices NULL
    assert got[("C", 1)] == (2, 0.0, 0)
    assert abs(got[("C", 3)][1] - 0.5) < 1e-12


def test_change_keeps_inf_for_counting(spark):
    df, schema = lag_table(spark)
    out, _ = features.change_metrics(df, schema, keep_inf=True, drop=())
    got = {(r.device, r.date.day): r.ch1 for r in out.collect()}
    assert got[("A", 4)] == float("inf") and got[("A", 7)] == float("inf")


def test_global_backfill_crosses_devices(spark):
    df, schema = lag_table(spark)
    out = features.elapsed_days(df, schema, fill="global")
    got = {(r.device, r.date.day): r.elapsed for r in out.collect()}
    assert got[("B", 3)] == 2                 # takes C's first gap
    assert got[("A", 1)] == 1


def test_global_backfill_goes_through_a_range_once(spark):
    df, schema = lag_table(spark)
    plan = features.elapsed_days(df, schema, fill="global")._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()


def test_global_backfill_equals_one_pass_over_the_sorted_rows(spark):
    import random
    rnd, rows = random.Random(4), []
    for i in range(120):
        days = sorted(rnd.sample(range(1, 29), rnd.choice([1, 1, 1, 3])))
        rows += [(f"d{i:03d}", dt.date(2015, 1, d), 0) for d in days]
    gaps, nxt, want = {}, None, {}
    for (a, x, _), (b, y, _) in zip(rows, rows[1:]):
        gaps[b, y] = (y - x).days if a == b else None
    for device, day, _ in reversed(rows):
        nxt = gaps.get((device, day)) or nxt
        want[device, day] = nxt
    df = spark.createDataFrame(rows, "device string, date date, m1 long").repartition(5)
    for parts in ("1", "6"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = features.elapsed_days(df, PanelSchema(num_cols=("m1",)), fill="global").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert {(r.device, r.date): r.elapsed for r in got} == want and len(got) == len(rows)


def test_rank_min_method(spark):
    vals = [0, 0, 0, 3, 3, 7, None, 1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k int, m1 long")
    out = {r.k: r.sr1 for r in min_rank(df, ["m1"]).collect()}
    n = len(vals)
    expect = {0: 0, 1: 0, 2: 0, 3: 4 / n, 4: 4 / n, 5: 6 / n, 6: None, 7: 3 / n}
    assert out == expect


def test_rank_all_equal_and_buckets_agree(spark):
    df = spark.createDataFrame([(i, 5) for i in range(10)], "k int, m1 long")
    assert {r.sr1 for r in min_rank(df, ["m1"]).collect()} == {0.0}
    import random
    rnd = random.Random(1)
    vals = [rnd.randint(0, 40) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(vals)), "k int, m1 long")
    want = {i: sum(1 for w in vals if w < v) / len(vals) for i, v in enumerate(vals)}
    for parts in ("1", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r.k: r.sr1 for r in min_rank(df, ["m1"]).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == want
    t = rank_table(df, ["m1"]).where(F.col("v").isNotNull())
    assert t.agg(F.max("n")).first()[0] == 300


def test_value_filter_modes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (None, 0), (1, 1)], "a int, b int")
    one = clean.value_filter(df, ["a", "b"], [0])
    assert sorted(map(tuple, one.collect()), key=str) == sorted([(0, 1), (1, 0), (None, 0), (1, 1)], key=str)
    two = clean.value_filter(df, ["a", "b"], [0, 1])           # OR of terms: nothing removed
    assert two.count() == 5
    both = clean.value_filter(df, ["a", "b"], [0], mode="all_differ")
    assert sorted(map(tuple, both.collect())) == [(1, 1)]
    assert clean.value_filter(df, ["a"], [None]).count() == 5


def test_zero_mark_and_strata(spark):
    rows = [(1, 0, 0, 0), (0, 0, 0, 0), (0, 2, -2, 0), (0, 0, 3, 0)]
    df = spark.createDataFrame(rows, "failure int, m2 long, m3 long, m9 long")
    out, s = features.full_zero_mark(df, PanelSchema())
    out, s = features.add_strata(out, s)
    got = [(r.f0, r.strt) for r in out.collect()]
    assert got == [(1, 2), (1, 0), (1, 0), (0, 1)]            # sum mode: signs cancel
    out2, _ = features.full_zero_mark(df, PanelSchema(), mode="all")
    assert [r.f0 for r in out2.collect()] == [1, 1, 0, 0]


def test_duplicate_column_detection(spark):
    df = spark.createDataFrame([(1, 1, 2), (2, 2, 2), (None, None, 1)], "m7 long, m8 long, m9 long")
    _, schema = clean.drop_duplicate_columns(df, PanelSchema(num_cols=("m7", "m8", "m9")), detect=True)
    assert schema.num_cols == ("m7", "m9")


def test_apply_rank_to_new_values(spark):
    from faultline.operators.rank import apply_rank
    fit = spark.createDataFrame([(i, v) for i, v in enumerate([0, 0, 0, 3, 3, 7])], "k int, m1 long")
    table = rank_table(fit, ["m1"])
    new = spark.createDataFrame([(0, 0), (1, 2), (2, 3), (3, 9), (4, -1), (5, None)], "k int, m1 long")
    got = {r.k: r.sr1 for r in apply_rank(new, table, "m1", "sr1").collect()}
    assert got == {0: 0.0, 1: 3 / 6, 2: 3 / 6, 3: 1.0, 4: 0.0, 5: None}


def test_skew_safe_lookups_hot_and_cold_paths(spark):
    from faultline.operators.lookup import skew_safe_lookup, skew_safe_metric_lookup
    vals = [0] * 60 + [1] * 25 + list(range(2, 17))          # 0 and 1 hot at hot_parts=4
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k int, m1 long")
    n = len(vals)
    table = spark.createDataFrame(
        [("m1", v, vals.count(v), n, sum(1 for w in vals if w < v)) for v in sorted(set(vals))],
        "metric string, v long, cnt long, n long, below long")
    want = {i: sum(1 for w in vals if w < v) / n for i, v in enumerate(vals)}
    long = df.select("k", F.lit("m1").alias("metric"), F.col("m1").alias("v"))
    out = skew_safe_metric_lookup(long, table.withColumn("sr1", F.col("below") / F.col("n")), ["sr1"], "k", hot_parts=4, salts=8)
    assert {r.k: r.sr1 for r in out.collect()} == want
    t1 = table.select("v", "cnt", "n", (F.col("below") / F.col("n")).alias("sr1"))
    out1 = skew_safe_lookup(df, "m1", t1, "v", ["sr1"], "cnt", "n", ["k"], hot_parts=4, salts=8)
    assert {r.k: r.sr1 for r in out1.collect()} == want


def test_small_cleaning_helpers(spark):
    df = spark.createDataFrame([(1, "a", 2)], "attribute1 int, device string, attribute2 int")
    r = clean.rename_substring(df, "attribute", "m")
    assert r.columns == ["m1", "device", "m2"]
    ins = clean.insert_columns(r, 1, f0=F.lit(0))
    assert ins.columns == ["m1", "f0", "device", "m2"]
    keys = spark.createDataFrame([("a",), ("a",)], "device string")
    assert clean.rows_for_keys(r, keys, ["device"]).count() == 1
