"""Transforms against small numpy references."""

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from faultline.functions import np_round, probit
from faultline.operators import transforms


def test_probit_matches_stdlib(spark):
    ps = [1e-9, 1e-7, 0.001, 0.02, 0.075, 0.3, 0.5, 0.5000001, 0.8, 0.925, 0.999, 1 - 1e-9]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(probit("p")).collect()]
    nd = NormalDist()
    for p, z in zip(ps, got):
        assert abs(z - nd.inv_cdf(p)) < 1e-12 * max(1, abs(z))


def numpy_quantile_transform(x, n_q=500):
    refs = np.linspace(0, 1, min(n_q, len(x)))
    q = np.percentile(x, refs * 100)
    out = 0.5 * (np.interp(x, q, refs) - np.interp(-x, -q[::-1], -refs[::-1]))
    out[x + 1e-7 > q[-1]] = 1
    out[x - 1e-7 < q[0]] = 0
    nd = NormalDist()
    lo, hi = nd.inv_cdf(1e-7 - np.spacing(1)), nd.inv_cdf(1 - (1e-7 - np.spacing(1)))
    return np.clip([nd.inv_cdf(u) if 0 < u < 1 else (lo if u <= 0 else hi) for u in out], lo, hi)


def test_quantile_transform_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros(300), rng.integers(1, 50, 600), rng.exponential(40, 300).round(1)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k int, v double")
    params = transforms.fit_quantiles(df, ["v"])
    out = transforms.apply_transforms(df, params).orderBy("k").collect()
    want = numpy_quantile_transform(x)
    assert np.allclose([r.v for r in out], want, atol=1e-9)


def test_scalers_constant_and_varying(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0), (3.0, 4.0)], "c double, d double")
    p = transforms.fit_scalers(df, minmax=["c", "d"], normal=[])
    got = df.select(*[transforms.transform_expr(k, p[k]).alias(k) for k in ("c", "d")]).collect()
    assert [r.c for r in got] == [0.0, 0.0, 0.0]
    assert [r.d for r in got] == [0.0, 1 / 3, 1.0]
    p = transforms.fit_scalers(df, normal=["c", "d"])
    got = df.select(*[transforms.transform_expr(k, p[k]).alias(k) for k in ("c", "d")]).collect()
    d = np.array([1.0, 2.0, 4.0])
    assert [r.c for r in got] == [0.0, 0.0, 0.0]
    assert np.allclose([r.d for r in got], (d - d.mean()) / d.std())


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    model = transforms.fit_pca(df, ["a", "b", "c", "d"])
    assert math.isclose(sum(model["ratio"]), 1.0, rel_tol=1e-12)
    scores = np.array([list(r) for r in transforms.apply_pca(df, model).collect()])
    cov = np.cov(scores, rowvar=False)
    assert np.allclose(cov - np.diag(np.diag(cov)), 0, atol=1e-8)
    xc = x - x.mean(axis=0)
    vals = np.linalg.svd(xc, compute_uv=False) ** 2
    assert np.allclose(model["ratio"], vals / vals.sum())


def test_one_hot_drops_first_sorted_category(spark):
    df = spark.createDataFrame([("b", 10), ("a", 9), ("c", 10)], "s string, n int")
    cats = transforms.fit_one_hot(df, ["s", "n"])
    assert cats == {"s": ["a", "b", "c"], "n": ["9", "10"]}
    assert transforms.one_hot_names(cats) == ["s_b", "s_c", "n_10"]


def test_numpy_style_rounding(spark):
    df = spark.createDataFrame([(0.125,), (2.675,), (0.5,), (1.5,)], "v double")
    got = [r[0] for r in df.select(np_round("v", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in (0.125, 2.675, 0.5, 1.5)] == [0.12, 2.68, 0.5, 1.5]
    got0 = [r[0] for r in df.select(np_round("v", 0)).collect()]
    assert got0 == [0.0, 3.0, 0.0, 2.0]


def test_yeo_johnson_lambda_near_numpy_grid(spark):
    rng = np.random.default_rng(11)
    x = rng.exponential(3.0, 500)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    lam = transforms.fit_yeo_johnson(df, ["v"])["v"]

    def llf(lmb):
        y = np.log1p(x) if abs(lmb) < 1e-12 else ((x + 1) ** lmb - 1) / lmb
        return -len(x) / 2 * np.log(y.var()) + (lmb - 1) * np.sum(np.log1p(x))
    grid = np.linspace(-3, 3, 60001)
    best = grid[np.argmax([llf(g) for g in grid])]
    assert abs(lam - best) < 2e-3


def test_moments_with_holes_equal_numpy(spark):
    from faultline.operators.moments import correlation, covariance
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) * [1, 1e6, 1e-3, 0] + [0, 1e9, 5, 7]
    holes = rng.random((200, 4)) < 0.1
    rows = [(i, *[None if h else (float("nan") if i % 50 == 1 and j == 0 else float(v)) for j, (v, h) in enumerate(zip(r, hs))]) for i, (r, hs) in enumerate(zip(x, holes))]
    df = spark.createDataFrame(rows, "k int, a double, b double, c double, d double").repartition(5)
    y = np.array([[np.nan if v is None else v for v in r[1:]] for r in rows])
    corr, (mean, cov) = correlation(df, ["a", "b", "c", "d"]), covariance(df, ["a", "b", "c", "d"])
    assert np.allclose(mean, np.nanmean(y, 0))
    for i in range(4):
        for j in range(4):
            both = ~np.isnan(y[:, i]) & ~np.isnan(y[:, j])
            want = np.cov(y[both, i], y[both, j])
            assert np.isclose(cov[i, j], want[0, 1], rtol=1e-9)
            assert (np.isnan(corr[i, j]) if 3 in (i, j) else np.isclose(corr[i, j], np.corrcoef(y[both, i], y[both, j])[0, 1]))
    none = df.where("false")
    assert np.isnan(correlation(none, ["a", "b"])).all() and not covariance(none, ["a", "b"])[1].any()


def test_a_fitted_encoding_is_applied_to_other_rows(spark):
    import pytest
    from faultline.operators import transforms
    fit = spark.createDataFrame([("x", 1), ("y", 2), ("z", 10), (None, 2)], "a string, b int")
    cats = transforms.fit_one_hot(fit, ["a", "b"])
    other = spark.createDataFrame([("z", 2), (None, None), ("x", 10)], "a string, b int")
    got = other.select(*transforms.apply_one_hot(other, cats))
    assert got.columns == ["a_y", "a_z", "b_2", "b_10"] and [tuple(r) for r in got.collect()] == [(0, 1, 1, 0), (0, 0, 0, 0), (0, 0, 0, 1)]
    with pytest.raises(Exception, match="not fitted: w"):
        spark.createDataFrame([("w", 1)], "a string, b int").select(*transforms.apply_one_hot(other, cats)).collect()


def test_scratch_tables_go(spark):
    import os
    from faultline.session import cut_lineage, ensure_checkpoint_dir, scratch_tables
    folder = ensure_checkpoint_dir(spark)
    before = set(os.listdir(folder))
    with scratch_tables(spark):
        outer = cut_lineage(spark.range(5))
        with scratch_tables(spark):
            assert cut_lineage(spark.range(3)).count() == 3
        assert outer.count() == 5 and len(set(os.listdir(folder)) - before) == 1
    assert set(os.listdir(folder)) == before


def test_yeo_johnson_reads_each_value_once(spark, monkeypatch):
    rng = np.random.default_rng(12)
    v = np.concatenate([np.zeros(300), rng.exponential(30, 200).round(1), -rng.exponential(5, 60).round(1)])
    df = spark.createDataFrame([(float(a), None if i % 9 == 0 else float(i % 4), 2.0) for i, a in enumerate(v)], "a double, b double, c double").repartition(5)
    read, plain = [], transforms._yj_table

    def table(*args):
        read.append(plain(*args))
        return read[-1]
    monkeypatch.setattr(transforms, "_yj_table", table)
    got = transforms.fit_yeo_johnson(df, ["a", "b", "c"])
    assert len(read) == 1 and read[0].count() == len(set(v)) + 4 + 1 and read[0].agg(F.sum("n")).first()[0] == df.count() * 2 + df.where("b IS NOT NULL").count()
    for name, x in (("a", v), ("b", np.array([i % 4 for i in range(len(v)) if i % 9], float))):
        def llf(lam):
            return -len(x) / 2 * math.log(transforms.yeo_johnson_values(x, lam).var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()
        assert all(llf(got[name]) >= llf(got[name] + d) - 1e-9 for d in (-0.05, -1e-3, 1e-3, 0.05))
    assert got["c"] == 1.0
    shown = df.select("a", transforms.yeo_johnson_expr(F.col("a"), 0.3).alias("y")).collect()
    assert np.allclose([r.y for r in shown], transforms.yeo_johnson_values(np.array([r.a for r in shown]), 0.3))
