"""Query catalogue: one function per analysis, ``(spark, sf_dir) -> DataFrame``.

Every query starts from the device-day panel derived from ``events`` so its
work grows with the data.  Column names match the SQL in ``plans.oracle``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from faultline.functions import abbreviate, np_round, stamp
from faultline.operators import clean, features, stats
from faultline.schema import METRIC_COLS, PanelSchema
from faultline.session import cut_lineage, ensure_checkpoint_dir
from faultline.sources import load_panel, read_result_csv, testdata_panel, write_result_csv
from faultline.sources.panel import dedup_by_device

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PanelSchema]:
    """Deduplicated test-data panel, hash-partitioned by device (see ``tidy_panel``)."""
    df, schema = testdata_panel(spark, sf_dir)
    return dedup_by_device(df), schema


def with_controls(spark, sf_dir, zero_mode: str = "sum"):
    df, schema = panel(spark, sf_dir)
    df, schema = features.full_zero_mark(df, schema, mode=zero_mode)
    return features.add_strata(df, schema)


def r6(c):
    return np_round(c, 6)


# ---- sources, shares -------------------------------------------------------

@query
def q_panel(spark, sf_dir):
    """S2 + P4 + P5 on the test data."""
    return panel(spark, sf_dir)[0]


@query
def q_target_share(spark, sf_dir):
    """A2: rows and percentage per target label."""
    return stats.target_share(panel(spark, sf_dir)[0], "failure")


@query
def q_strata_share(spark, sf_dir):
    """F3 + F4 + A1: rows and share per stratum."""
    df, _ = with_controls(spark, sf_dir)
    return stats.value_share(df, "strt")


@query
def q_zero_pct(spark, sf_dir):
    """A3 + R2: percentage of zero cells per metric and target class."""
    df, _ = panel(spark, sf_dir)
    return stats.value_percentage(df, METRIC_COLS, by="failure", values=[0])


@query
def q_full_zero_pct(spark, sf_dir):
    """F3 + A3: percentage of rows whose zero-dense metrics sum to 0, per class."""
    df, _ = panel(spark, sf_dir)
    df, _ = features.full_zero_mark(df, PanelSchema())
    return stats.value_percentage(df, ["f0"], by="failure", values=[1])


@query
def q_nonzero_stats(spark, sf_dir):
    """A4 + A5 + R1 + R4: mean / std with and without zeros per class."""
    df, _ = panel(spark, sf_dir)
    out = stats.class_moments(df, METRIC_COLS, "failure", nonzero=True)
    return out.withColumn("value", r6(F.col("value")))


@query
def q_filter_any(spark, sf_dir):
    """P7 parity mode: terms OR-ed."""
    return clean.value_filter(panel(spark, sf_dir)[0], ["m2", "m3"], [0], mode="any_differs")


@query
def q_filter_all(spark, sf_dir):
    """P7 documented intent: terms AND-ed."""
    return clean.value_filter(panel(spark, sf_dir)[0], ["m2", "m3"], [0], mode="all_differ")


@query
def q_device_features(spark, sf_dir):
    df, schema = panel(spark, sf_dir)
    return features.device_features(df, schema)[0]


@query
def q_date_features(spark, sf_dir):
    df, schema = panel(spark, sf_dir)
    return features.date_features(df, schema)[0]


@query
def q_category_share(spark, sf_dir):
    """A6 + J3 + R3: share of each device level / weekday within each class."""
    df, schema = panel(spark, sf_dir)
    df, schema = features.device_features(df, schema)
    df, schema = features.date_features(df, schema)
    return stats.category_counts(df, "failure", ["L1", "L2", "WD"], proportion=True)


# ---- per-device windows ------------------------------------------------------

def panel_no_dup(spark, sf_dir):
    """Panel after P6 (the duplicate metric m8 removed)."""
    df, schema = panel(spark, sf_dir)
    return clean.drop_duplicate_columns(df, schema)


@query
def q_elapsed(spark, sf_dir):
    """W1 + W2 (device-local back-fill)."""
    df, schema = panel(spark, sf_dir)
    return features.elapsed_days(df, schema, fill="device")


@query
def q_elapsed_global_fill(spark, sf_dir):
    """W1 + W2 with the whole-frame back-fill of the study."""
    df, schema = panel(spark, sf_dir)
    return features.elapsed_days(df, schema, fill="global")


@query
def q_change(spark, sf_dir):
    """F5 (toolkit variant): ch1, ch2, ch4..ch7 with inf replaced by 0."""
    df, schema = panel_no_dup(spark, sf_dir)
    return features.change_metrics(df, schema)[0]


@query
def q_change_inf_pct(spark, sf_dir):
    """W3 + A3: share of infinite changes per class (notebook variant keeps all columns)."""
    df, schema = panel_no_dup(spark, sf_dir)
    out, schema = features.change_metrics(df, schema, keep_inf=True, drop=(), fill="global")
    return stats.value_percentage(out, schema.chng_cols, by="failure", values=[float("inf")])


@query
def q_switch(spark, sf_dir):
    """on/off switches."""
    df, schema = panel_no_dup(spark, sf_dir)
    return features.switch_metrics(df, schema)[0]


@query
def q_switch_pct(spark, sf_dir):
    """W4 + A3: share of switches (-1 or 1) per class."""
    df, schema = panel_no_dup(spark, sf_dir)
    out, _ = features.switch_metrics(df, schema)
    sw = [m.replace("m", "sw", 1) for m in schema.num_cols]
    return stats.value_percentage(out, sw, by="failure", values=[-1, 1])


@query
def q_rank(spark, sf_dir):
    """F7 (toolkit variant): sr2, sr3, sr4, sr7, sr9, srmx."""
    df, schema = panel_no_dup(spark, sf_dir)
    return features.rank_metrics(df, schema)[0]


@query
def q_rank_aggs(spark, sf_dir):
    """F7 (notebook variant): every sr*, plus srav and srmx."""
    df, schema = panel_no_dup(spark, sf_dir)
    return features.rank_metrics(df, schema, drop=())[0]


# ---- correlation, distributions ---------------------------------------------

from faultline.operators import corr as corr_ops, density as density_ops  # noqa: E402


@query
def q_corr(spark, sf_dir):
    """Pearson correlation of every metric pair (rounded to 6)."""
    df, _ = panel(spark, sf_dir)
    out = corr_ops.pearson_long(df, METRIC_COLS)
    return out.withColumn("corr", r6(F.col("corr")))


@query
def q_corr_display(spark, sf_dir):
    """P8 + A7 + A8: display table of correlations on rows that are not all-zero."""
    df, schema = with_controls(spark, sf_dir)
    c = corr_ops.pearson_long(df.where(F.col("f0") == 0), METRIC_COLS)
    return corr_ops.corr_display(c, METRIC_COLS)


@query
def q_dup_columns(spark, sf_dir):
    """Rows on which each metric pair differs (0 = duplicate column)."""
    df, _ = panel(spark, sf_dir)
    return corr_ops.pair_differences(df, METRIC_COLS)


@query
def q_dist_summary(spark, sf_dir):
    """A11 + P9: n, mean, std per metric and class without zeros."""
    df, _ = panel(spark, sf_dir)
    out = stats.dist_summary(df, METRIC_COLS, "failure", remove=[0])
    return out.withColumn("mean", r6(F.col("mean"))).withColumn("std", r6(F.col("std")))


@query
def q_density(spark, sf_dir):
    """Gaussian KDE grid per metric and class (Scott bandwidth)."""
    df, _ = panel(spark, sf_dir)
    out = density_ops.density_grid(df, METRIC_COLS, "failure")
    return out.withColumn("x", r6(F.col("x"))).withColumn("density", r6(F.col("density")))


# ---- sampling and splitting --------------------------------------------------

from faultline.operators import sampling  # noqa: E402
from faultline.schema import BEST_STRATA_P, RANDOM_STATE, STRATA_P  # noqa: E402

KEY = ["device", "date"]


@query
def q_undersample_counts(spark, sf_dir):
    """M1: rows per stratum in a stratified under-sample."""
    df, _ = with_controls(spark, sf_dir)
    return sampling.undersample_counts(df, "strt", STRATA_P)


@query
def q_undersample(spark, sf_dir):
    """Exact stratified under-sample, seeded hash order."""
    df, _ = with_controls(spark, sf_dir)
    counts = sampling.undersample_counts(df, "strt", STRATA_P)
    return sampling.stratified_undersample(df, "strt", counts, RANDOM_STATE, KEY)


@query
def q_undersample_ratio(spark, sf_dir):
    """M3: binary under-sample to 30 % failures."""
    df, _ = panel(spark, sf_dir)
    counts = sampling.ratio_counts(df, "failure", 0.3)
    quota = counts.select(F.col("failure").cast("int").alias("failure"), "n")
    return sampling.take_smallest(df, ["failure"], sampling.hash_order(RANDOM_STATE, *KEY), quota, ties=KEY)


def split_controls(spark, sf_dir):
    """The split panel; written once, as the split's threshold, counts and bags all read it."""
    df, schema = with_controls(spark, sf_dir)
    return sampling.train_test_split(cut_lineage(df), KEY, 0.2, RANDOM_STATE), schema


@query
def q_split(spark, sf_dir):
    """M4: the test rows are ceil(20 %) of all, by their key hashes."""
    return sampling.train_test_split(cut_lineage(panel(spark, sf_dir)[0]), KEY, 0.2, RANDOM_STATE)


@query
def q_split_balance(spark, sf_dir):
    """Target and strata balance of the split."""
    df, _ = split_controls(spark, sf_dir)
    return sampling.split_balance(df, "failure").unionByName(sampling.split_balance(df, "strt"))


@query
def q_folds(spark, sf_dir):
    """M8: five exact stratified folds."""
    df, _ = with_controls(spark, sf_dir)
    return sampling.stratified_folds(df, "strt", RANDOM_STATE, KEY, 5)


def train_bags(spark, sf_dir, bags=None, strata_p=STRATA_P):
    """Training rows, their counts, and their bags: ``bags``, or as many as the proxy (M6) says."""
    df, _ = split_controls(spark, sf_dir)
    train = df.where(F.col("split") == "train")
    counts = sampling.undersample_counts(train, "strt", strata_p)
    full = sampling.undersample_counts(df, "strt", strata_p)
    est = sampling.estimators_proxy(full, counts, "strt", 1)
    counts = counts.join(est, "strt", "left")                                       # a row per stratum
    sized = counts.withColumn("bags", F.greatest(F.max("estimators").over(Window.partitionBy()), F.lit(1)))
    return train, counts, sampling.bag_membership(train, "strt", sized, bags, RANDOM_STATE, KEY)


@query
def q_bags(spark, sf_dir):
    """M7: per-bag exact stratified under-samples of the training rows."""
    _, _, b = train_bags(spark, sf_dir)
    return b.select("bag", "device", "date", "strt")


@query
def q_bag_coverage(spark, sf_dir):
    """M6 + M7: share of each training stratum reached by the bags, and the estimator proxy."""
    _, counts, b = train_bags(spark, sf_dir)
    covered = b.select("strt", "device", "date").distinct().groupBy("strt").agg(
        F.count(F.lit(1)).alias("covered"))
    return (counts.join(covered, "strt", "left")
            .select("strt", "n_rows", "n", F.coalesce("covered", F.lit(0)).alias("covered"),
                    (F.coalesce("covered", F.lit(0)) / F.col("n_rows")).alias("coverage"), "estimators"))


@query
def q_undersample_counts_cv(spark, sf_dir):
    """M1 with the cross-validation factor: 80 % of the rows per stratum."""
    df, _ = with_controls(spark, sf_dir)
    return sampling.undersample_counts(df, "strt", STRATA_P, cv=True)


@query
def q_bag_draws(spark, sf_dir):
    """M7 by block draws, as the ensembles use it: bags of the final model's proportions."""
    df, _ = split_controls(spark, sf_dir)
    train = df.where(F.col("split") == "train")
    counts = sampling.undersample_counts(train, "strt", BEST_STRATA_P)
    return sampling.draw_bags(train, "strt", counts, FINAL_BAGS, RANDOM_STATE, KEY).select("bag", "device", "date", "strt")


# ---- transforms -----------------------------------------------------------------

from faultline.operators import transforms  # noqa: E402
from faultline.operators.prepare import model_features, prepare  # noqa: E402
from faultline.schema import TRANSFORM_PLAN  # noqa: E402

CH_COLS, NRM_COLS, QT_COLS = ([c for c, code in TRANSFORM_PLAN.items() if code == k] for k in ("mnmx", "nrm", "qt"))


def change_table(spark, sf_dir):
    df, schema = panel_no_dup(spark, sf_dir)
    return features.change_metrics(df, schema)


@query
def q_minmax(spark, sf_dir):
    """min-max scaling of the change metrics."""
    df, _ = change_table(spark, sf_dir)
    params = transforms.fit_scalers(df, minmax=CH_COLS)
    return df.select("device", "date", *[r6(transforms.transform_expr(c, params[c])).alias(c) for c in CH_COLS])


@query
def q_standard(spark, sf_dir):
    """standard scaling (population std) of the zero-dense metrics."""
    df, _ = panel(spark, sf_dir)
    params = transforms.fit_scalers(df, normal=NRM_COLS)
    return df.select("device", "date", *[r6(transforms.transform_expr(c, params[c])).alias(c) for c in NRM_COLS])


@query
def q_quantile(spark, sf_dir):
    """quantile transform (500 knots, normal output)."""
    df, _ = panel(spark, sf_dir)
    params = transforms.fit_quantiles(df, QT_COLS)
    out = transforms.apply_transforms(df, params)
    return out.select("device", "date", *[r6(F.col(c)).alias(c) for c in QT_COLS])


@query
def q_yeo_johnson(spark, sf_dir):
    """Yeo-Johnson of all metrics with max-likelihood lambda, standardised."""
    df, _ = panel(spark, sf_dir)
    df = cut_lineage(df.select("device", "date", *METRIC_COLS))    # every fit pass reads it
    params = transforms.fit_power(df, METRIC_COLS)
    return df.select("device", "date", *[r6(transforms.transform_expr(c, params[c])).alias(c) for c in METRIC_COLS])


def feature_table(spark, sf_dir):
    df, schema = panel(spark, sf_dir)
    return features.build_features(df, schema)


@query
def q_features(spark, sf_dir):
    """F8: the full feature table (duplicate dropped, id/date parts, change, rank, f0, strata)."""
    return feature_table(spark, sf_dir)[0]


ENC_COLS = ["L1", "L2", "L12", "Q", "M", "D", "MW", "WD", "WE"]


@query
def q_one_hot(spark, sf_dir):
    """One-hot cells equal to 1 (first category dropped), sparse long form."""
    df, schema = panel(spark, sf_dir)
    df, schema = features.device_features(df, schema)
    df, schema = features.date_features(df, schema)
    return transforms.one_hot_long(df, ENC_COLS, ["device", "date"])


@query
def q_transform(spark, sf_dir):
    """the transformation plan applied to the feature table."""
    df, schema = feature_table(spark, sf_dir)
    df = cut_lineage(df)
    params = transforms.fit_transforms(df, TRANSFORM_PLAN)
    out = transforms.apply_transforms(df, params)
    return out.select("device", "date", *[r6(F.col(c)).alias(c) for c in TRANSFORM_PLAN])


def rounded(df, cols):
    """``cols`` to six digits, no negative zero."""
    return df.withColumns({c: r6(F.col(c)) + F.lit(0.0) for c in cols})


@query
def q_pca(spark, sf_dir):
    """PCA scores of the transformed numeric features."""
    df, schema = feature_table(spark, sf_dir)
    df = cut_lineage(df)
    t = transforms.apply_transforms(df, transforms.fit_transforms(df, TRANSFORM_PLAN))
    model = transforms.fit_pca(t, list(schema.nnum_cols))
    return rounded(transforms.apply_pca(t, model, keep=["device", "date"]), model["names"])


@query
def q_pca_trace(spark, sf_dir):
    """Number of components and their total variance (the trace of the covariance)."""
    df, schema = feature_table(spark, sf_dir)
    df = cut_lineage(df)
    t = transforms.apply_transforms(df, transforms.fit_transforms(df, TRANSFORM_PLAN))
    model = transforms.fit_pca(t, list(schema.nnum_cols))
    return spark.createDataFrame([(len(model["variance"]), sum(model["variance"]), sum(model["ratio"]))],
                                 "components int, total double, share double").select(
        "components", r6(F.col("total")).alias("total"), r6(F.col("share")).alias("share"))


@query
def q_scree(spark, sf_dir):
    """explained variance ratio and its running sum per component."""
    df, schema = feature_table(spark, sf_dir)
    df = cut_lineage(df)
    t = transforms.apply_transforms(df, transforms.fit_transforms(df, TRANSFORM_PLAN))
    return rounded(transforms.scree_table(spark, transforms.fit_pca(t, list(schema.nnum_cols))), ["var", "cumvar"])


@query
def q_prepared(spark, sf_dir):
    """Model table with one-hot, PCA numerics and controls."""
    df, schema = feature_table(spark, sf_dir)
    df = cut_lineage(df)
    out, prepared = prepare(df, schema, num_transform=True)
    return rounded(out, prepared.pca_cols)


# ---- evaluation on a deterministic score ---------------------------------------

from faultline.operators import evaluate  # noqa: E402


def scored(spark, sf_dir):
    """Panel with the fixture scores (overlapping classes, many ties)."""
    df, _ = panel(spark, sf_dir)
    s1 = F.least(F.lit(1.0), (2 * F.col("failure") + F.col("m5") + F.col("m2")) / F.lit(16.0))
    s2 = F.least(F.lit(1.0), (F.col("failure") + F.col("m3") + F.col("m9")) / F.lit(8.0))
    return df.withColumn("y_proba", s1).withColumn("y_proba2", s2)


@query
def q_confusion(spark, sf_dir):
    """Confusion counts at threshold 0.5."""
    return evaluate.confusion(scored(spark, sf_dir), "failure", "y_proba", 0.5)


@query
def q_scores(spark, sf_dir):
    """F1 / recall / precision at 0.95 and AUROC for two scores."""
    df = scored(spark, sf_dir)
    preds = (df.select("failure", F.lit("s1").alias("model"), F.col("y_proba").alias("p"))
             .unionByName(df.select("failure", F.lit("s2").alias("model"), F.col("y_proba2").alias("p"))))
    out = evaluate.model_scores(preds, "failure", "p", 0.95)
    return out.withColumn("auroc", r6(F.col("auroc")))


@query
def q_pr_curve(spark, sf_dir):
    """Precision-recall curve with F1 per point."""
    return evaluate.pr_curve(scored(spark, sf_dir), "failure", "y_proba")


@query
def q_best_threshold(spark, sf_dir):
    """Best F1 threshold."""
    return evaluate.best_threshold(evaluate.pr_curve(scored(spark, sf_dir), "failure", "y_proba"))


@query
def q_auc(spark, sf_dir):
    """Exact AUROC with ties."""
    out = evaluate.auc(scored(spark, sf_dir), "failure", "y_proba")
    return out.withColumn("auroc", r6(F.col("auroc")))


@query
def q_threshold_sweep(spark, sf_dir):
    """Confusion at the fixed thresholds and at the best-F1 threshold."""
    df = scored(spark, sf_dir)
    best = evaluate.best_threshold(evaluate.pr_curve(df, "failure", "y_proba")).first()["threshold"]
    ts = evaluate.SWEEP + ([best] if best is not None else [])
    return evaluate.threshold_sweep(df, "failure", "y_proba", ts)


# ---- ensembles, search, ablation ---------------------------------------------------

from faultline.operators import ensemble, forest  # noqa: E402
from faultline.schema import BOOST_GRID, FOREST_GRID, STRATA_GRID  # noqa: E402

# Bags of an ensemble: None sizes it by ``sampling.estimators_proxy``, as the study does
# (about 280 there), but for its final model; the queries take any number as ``bags``.
ENSEMBLE_BAGS = None
FINAL_BAGS, FINAL_ROUNDS, FINAL_DEPTH = 200, 20, 40     # of the study's final model
BOOST_VOTES = "probability"             # the default of the study's library; "discrete" is plain SAMME, whose shares stay far below 0.9


def model_table(spark, sf_dir, num_transform: bool = False):
    """feature table -> prepared model columns, plus the 80/20 split.

    The feature table is written once because every fit pass reads it, and the
    prepared table because bags and folds scan it repeatedly.
    """
    df, schema = feature_table(spark, sf_dir)
    prep, pschema = prepare(cut_lineage(df), schema, num_transform=num_transform)
    prep = cut_lineage(sampling.train_test_split(prep, KEY, 0.2, RANDOM_STATE))
    return prep, model_features(schema, pschema, num_transform)


def proxy_bags(prep, train, strata_p=STRATA_P):
    """M6: bags of an ensemble, at least one."""
    full, counts = (sampling.undersample_counts(x, "strt", strata_p) for x in (prep, train))
    est = sampling.estimators_proxy(full, counts, "strt", 1).first()
    return max(1, est["estimators"] or 1) if est else 1


def _strata_fit(table, base, strata_p, bags=ENSEMBLE_BAGS, **kw):
    """Stratified bagging on the training rows: the ensemble, and the column of the failure's probability."""
    prep, feats = table
    train = prep.where(F.col("split") == "train")
    counts = sampling.undersample_counts(train, "strt", strata_p)
    bags = proxy_bags(prep, train) if bags is None else bags
    return ensemble.fit_bagged(train, feats, "strt", "strt", counts, bags, RANDOM_STATE,
                               base=base, class_weight=strata_p, **kw), "p2"


def _ratio_fit(table, base, bags=ENSEMBLE_BAGS, **kw):
    """Binary bagging on 30 % failure under-samples of the training rows."""
    prep, feats = table
    train = prep.where(F.col("split") == "train")
    counts = sampling.ratio_counts(train, "failure", 0.3).withColumnRenamed("failure", "strt_y")
    bags = proxy_bags(prep, train) if bags is None else bags
    return ensemble.fit_bagged(train.withColumn("strt_y", F.col("failure")), feats, "failure", "strt_y",
                               counts.select("strt_y", "n_rows", "n"), bags, RANDOM_STATE, base=base, class_weight={0: 0.7, 1: 0.3},
                               n_classes=2, **kw), "p1"


def _scores(table, fitted, side="test"):
    ens, p = fitted
    rows = table[0].where(F.col("split") == side)
    return ensemble.predict_bagged(ens, rows, ["device", "date", "strt", "failure"]).withColumn("y_proba", F.col(p))


def _strata_fit_predict(spark, sf_dir, base, strata_p, num_transform=False, bags=ENSEMBLE_BAGS, **kw):
    table = model_table(spark, sf_dir, num_transform)
    return _scores(table, _strata_fit(table, base, strata_p, bags, **kw))


def _ratio_fit_predict(spark, sf_dir, base, num_transform=False, bags=ENSEMBLE_BAGS, **kw):
    table = model_table(spark, sf_dir, num_transform)
    return _scores(table, _ratio_fit(table, base, bags, **kw))


@query
def q_bag_logistic(spark, sf_dir, bags=ENSEMBLE_BAGS):
    """L1 + L6: stratified bagging of multinomial logistic regressions, test-set scores."""
    return _strata_fit_predict(spark, sf_dir, "logistic", STRATA_P, num_transform=True, bags=bags)


@query
def q_bag_logistic_ratio(spark, sf_dir, bags=ENSEMBLE_BAGS):
    """L2: binary bagging of logistic regressions on 30 % failure under-samples."""
    return _ratio_fit_predict(spark, sf_dir, "logistic", num_transform=True, bags=bags)


@query
def q_bag_forest(spark, sf_dir, bags=ENSEMBLE_BAGS, depth=None):
    """L3: balanced forest — one unbootstrapped tree per stratified bag, of any depth."""
    return _strata_fit_predict(spark, sf_dir, "forest", STRATA_P, bags=bags, depth=depth, max_features="sqrt")


@query
def q_bag_forest_ratio(spark, sf_dir, bags=ENSEMBLE_BAGS, depth=None):
    """L3, fourth candidate: binary balanced forest on 30 % failure under-samples."""
    return _ratio_fit_predict(spark, sf_dir, "forest", bags=bags, depth=depth, max_features="sqrt")


@query
def q_tree_stump(spark, sf_dir):
    """L3 on a fixed plan: the first split of a tree over all training rows, every numeric feature looked at, with its sides' class weights."""
    df, schema = feature_table(spark, sf_dir)
    train = sampling.train_test_split(cut_lineage(df), KEY, 0.2, RANDOM_STATE).where("split = 'train'").withColumn("bag", F.lit(0))
    nums = list(schema.nnum_cols)
    cuts = forest.fit_bins(train, nums)
    plan = [forest.Model(0, 0, depth=1, mtry=len(nums), weights=tuple(STRATA_P[c] for c in range(3)))]
    nodes = forest.fit_forest(ensemble.binned_bags(train, "strt", nums, cuts), plan, nums, cuts, 3).nodes
    names = F.array(*[F.lit(c) for c in nums])
    values = F.array(*[F.array(*[F.lit(float(v)) for v in c]) if len(c) else F.array().cast("array<double>") for c in cuts])
    top = nodes.where("f >= 0").select("lo", "hi", F.element_at(names, F.col("f") + 1).alias("feature"),
                                       F.element_at(F.element_at(values, F.col("f") + 1), F.col("b")).alias("cut"))
    side = nodes.select(F.col("node"), *[r6(F.col("sums")[c]).alias(f"w{c}") for c in range(3)])
    return top.select("feature", "cut", F.explode(F.create_map(F.lit("left"), F.col("lo"), F.lit("right"), F.col("hi"))).alias("side", "node")).join(
        side, "node").drop("node")


@query
def q_bag_boost(spark, sf_dir, bags=FINAL_BAGS, rounds=FINAL_ROUNDS):
    """L4 + L5: bagging of SAMME-boosted trees with the final configuration's strata, bags and rounds."""
    return _strata_fit_predict(spark, sf_dir, "boost", BEST_STRATA_P, bags=bags, depth=FINAL_DEPTH, max_features="0.5", rounds=rounds, votes=BOOST_VOTES)


@query
def q_bag_boost_ratio(spark, sf_dir, bags=ENSEMBLE_BAGS, rounds=FINAL_ROUNDS):
    """L4, sixth candidate: binary bagging of boosted trees on 30 % failure under-samples."""
    return _ratio_fit_predict(spark, sf_dir, "boost", bags=bags, depth=FINAL_DEPTH, max_features="0.5", rounds=rounds, votes=BOOST_VOTES)


@query
def q_candidate_scores(spark, sf_dir, bags=ENSEMBLE_BAGS, rounds=FINAL_ROUNDS):
    """F1, recall, precision at 0.95 and AUROC of the six candidates on the training rows, with their confusion counts."""
    pca, plain = model_table(spark, sf_dir, True), model_table(spark, sf_dir, False)
    tree = {"depth": None, "max_features": "sqrt"}
    boost = {"depth": FINAL_DEPTH, "max_features": "0.5", "rounds": rounds, "votes": BOOST_VOTES}
    fits = [("strata logistic", pca, _strata_fit(pca, "logistic", STRATA_P, bags)), ("ratio logistic", pca, _ratio_fit(pca, "logistic", bags)),
            ("strata forest", plain, _strata_fit(plain, "forest", STRATA_P, bags, **tree)), ("ratio forest", plain, _ratio_fit(plain, "forest", bags, **tree)),
            ("strata boost", plain, _strata_fit(plain, "boost", STRATA_P, bags, **boost)), ("ratio boost", plain, _ratio_fit(plain, "boost", bags, **boost))]
    told = None
    for name, table, fitted in fits:
        one = _scores(table, fitted, "train").select(F.lit(name).alias("model"), "failure", "y_proba")
        told = one if told is None else told.unionByName(one)
    return evaluate.model_scores(cut_lineage(told), "failure", "y_proba", 0.95)


SEARCH_SCHEMA = ("class_weight map<string,double>, sampling_strategy map<string,bigint>, bags int, bootstrap boolean, depth int, "
                 "max_features string, min_samples_leaf int, min_samples_split int")
SEARCH_PARAMS = ["class_weight", "bags", "bootstrap", "depth", "max_features", "min_samples_leaf", "min_samples_split"]
# Random draws from the grid's 3456 configurations (the study's first search draws 500); each is 5 folds x 250 to 450 trees.
SEARCH_DRAWS = 8
BOOST_DRAWS = 4         # of 5760 for bagged boosting (the study: 750), each 5 folds x 200 to 450 bags x 10 to 30 rounds


def search_grid(train, params=FOREST_GRID):
    """The study's grid: strata proportions with their fixed counts (80 % of the training rows'), and the trees' parameters."""
    grids = []
    for p in STRATA_GRID:
        counts = sampling.undersample_counts(train, "strt", p, cv=True).collect()             # a row per stratum
        grids.append({"class_weight": [{str(k): v for k, v in p.items()}],
                      "sampling_strategy": [{str(r["strt"]): r["n"] for r in counts}], **params})
    return grids


def search_results(spark, sf_dir, draws=SEARCH_DRAWS, folds=5, bags=ENSEMBLE_BAGS, base="forest", params=FOREST_GRID):
    """``draws`` random configurations of the study's grid for balanced forests, or for bagged boosted
    trees; ``bags`` stands for a grid without its own."""
    prep, feats = model_table(spark, sf_dir, False)
    train = prep.where(F.col("split") == "train")
    bags = proxy_bags(prep, train) if bags is None else bags
    return ensemble.random_search(train, feats, search_grid(train, params), n_iter=draws, folds=folds, seed=RANDOM_STATE,
                                  fit_kwargs={"bags": bags, "base": base, "class_weight": STRATA_P, "votes": BOOST_VOTES})


@query
def q_search_table(spark, sf_dir, draws=SEARCH_DRAWS):
    """L15 + L16: random search over forest bagging, parsed and ranked result table."""
    return evaluate.search_table(search_results(spark, sf_dir, draws), SEARCH_SCHEMA)


@query
def q_search_boost_table(spark, sf_dir, draws=BOOST_DRAWS):
    """L15 + L16, the second search: bagged boosted trees, parsed and ranked result table."""
    found = search_results(spark, sf_dir, draws, base="boost", params=BOOST_GRID)
    return evaluate.search_table(found, "class_weight map<string,double>, sampling_strategy map<string,bigint>, bags int, "
                                 "bootstrap boolean, depth int, max_features string, rounds int")


@query
def q_param_marginals(spark, sf_dir, draws=SEARCH_DRAWS):
    """Mean F1 per parameter value of the search."""
    t = evaluate.search_table(search_results(spark, sf_dir, draws), SEARCH_SCHEMA)
    return evaluate.param_marginals(t, SEARCH_PARAMS)


@query
def q_search_best(spark, sf_dir, draws=SEARCH_DRAWS):
    """L15 refit: the best configuration of the search on all training rows, and its test scores at its best threshold."""
    prep, feats = model_table(spark, sf_dir, False)
    train, test = prep.where(F.col("split") == "train"), prep.where(F.col("split") == "test")
    bags = proxy_bags(prep, train)
    found = ensemble.random_search(train, feats, search_grid(train), n_iter=draws, folds=5, seed=RANDOM_STATE,
                                   fit_kwargs={"bags": bags, "base": "forest", "class_weight": STRATA_P})
    best = evaluate.best_row(found).first()
    ens = ensemble.refit(train, feats, best["params"], RANDOM_STATE, {"bags": bags, "base": "forest", "class_weight": STRATA_P})
    pr = cut_lineage(ensemble.predict_bagged(ens, test, ["strt"]).withColumn("y", (F.col("strt") == 2).cast("int")))
    _, at, conf = evaluate.pr_report(pr, "y", "p2")
    told = evaluate.with_rates(conf)
    return told.select(F.lit(best["config"]).alias("config"), F.lit(best["params"]).alias("params"), F.lit(best["mean_test_f1"]).alias("mean_test_f1"),
                       F.lit(at).cast("double").alias("threshold"), *told.columns)


@query
def q_ablation_table(spark, sf_dir, bags=FINAL_BAGS, rounds=FINAL_ROUNDS):
    """L18 + L19: leave-one-feature-out scores against the final boosted ensemble at its best threshold, melted."""
    prep, feats = model_table(spark, sf_dir, False)
    train, test = prep.where(F.col("split") == "train"), prep.where(F.col("split") == "test")
    counts = sampling.undersample_counts(train, "strt", BEST_STRATA_P)
    kw = {"bags": bags, "base": "boost", "class_weight": BEST_STRATA_P, "depth": FINAL_DEPTH, "max_features": "0.5", "rounds": rounds, "votes": BOOST_VOTES}
    nums = [c for c in feats if "_" not in c]
    full = ensemble.fit_bagged(train, feats, "strt", "strt", counts, seed=RANDOM_STATE, **kw)
    pr = cut_lineage(ensemble.predict_bagged(full, test, ["strt"]).withColumn("y", (F.col("strt") == 2).cast("int")))
    _, best, conf = evaluate.pr_report(pr, "y", "p2")
    base = evaluate.with_rates(conf).first().asDict()
    ab = ensemble.ablation(train, test, feats, kw, counts, best if best is not None else float("inf"), RANDOM_STATE, leave=nums)
    return evaluate.ablation_vs_baseline(ab, base)


# ---- small report aggregates -------------------------------------------------------

@query
def q_distinct_levels(spark, sf_dir):
    """Distinct device families."""
    df, schema = panel(spark, sf_dir)
    return stats.distinct_values(features.device_features(df, schema)[0], "L12")


@query
def q_score_range(spark, sf_dir):
    """Largest and smallest score, and their difference."""
    return stats.score_range(scored(spark, sf_dir), "y_proba")


@query
def q_best_day_metric(spark, sf_dir):
    """The operation count with the best failure share (ties: the smallest)."""
    df, _ = panel(spark, sf_dir)
    share = df.groupBy("m5").agg(F.avg(F.col("failure").cast("double")).alias("share"))
    return stats.arg_best(share, "share", "m5")


@query
def q_shape(spark, sf_dir):
    """Rows and columns of the panel."""
    return stats.shape(panel(spark, sf_dir)[0])


# ---- rug sample, bootstrap -------------------------------------------------------

@query
def q_rug_sample(spark, sf_dir):
    """Up to 2500 seeded rows per metric and class (distribution rug data)."""
    df, _ = panel(spark, sf_dir)
    return sampling.rug_sample(df, list(METRIC_COLS), "failure", 2500, RANDOM_STATE, KEY)


@query
def q_bootstrap(spark, sf_dir):
    """M9: Poisson(1) bootstrap counts of the training rows for three bags."""
    df, _ = split_controls(spark, sf_dir)
    train = df.where(F.col("split") == "train")
    return sampling.bootstrap_weights(train, 3, RANDOM_STATE, KEY).select("bag", "device", "date", "strt", "weight")


# ---- names, keys, files -----------------------------------------------------------

@query
def q_rename(spark, sf_dir):
    """P3 + P4 + X2: metrics renamed by a part of their names, a computed column put in the third place."""
    df = clean.rename_substring(panel(spark, sf_dir)[0], "m", "metric_", METRIC_COLS)
    return clean.insert_columns(df, 2, n_zero=F.aggregate(F.array(*[(F.col(c.replace("m", "metric_")) == 0).cast("int") for c in METRIC_COLS]),
                                                          F.lit(0), lambda a, x: a + x))


@query
def q_rows_for_keys(spark, sf_dir):
    """The rows of every device that has failed once."""
    df, _ = panel(spark, sf_dir)
    return clean.rows_for_keys(df, df.where("failure = 1").select("device"), ["device"])


@query
def q_abbreviated(spark, sf_dir):
    """X9 + X12: readable sums of the metrics per device, and the stamp of its last day."""
    df, _ = panel(spark, sf_dir)
    per = df.groupBy("device").agg(*[F.sum(c).alias(c) for c in ("m1", "m6")], F.max("date").alias("last"))
    return per.select("device", abbreviate("m1", True).alias("m1"), abbreviate("m6", True).alias("m6"),
                      stamp(F.col("last").cast("timestamp")).alias("last"))


@query
def q_strata_scores(spark, sf_dir):
    """L13 + X15: F1 at 0.5 and AUROC of the failing class after collapsing strata, of a fixture score."""
    df, _ = with_controls(spark, sf_dir)
    s1 = F.least(F.lit(1.0), (2 * F.col("failure") + F.col("m5") + F.col("m2")) / F.lit(16.0))
    x = df.select("strt", s1.alias("p2"))
    return evaluate.strata_f1(x, 0.5).select(r6(F.col("f1")).alias("value"), F.lit("f1").alias("score")).unionByName(
        evaluate.strata_auc(x).select(r6(F.col("auroc")).alias("value"), F.lit("auroc").alias("score")))


@query
def q_pr_points(spark, sf_dir):
    """P10: the melted precision-recall points without F1."""
    curve = evaluate.pr_curve(scored(spark, sf_dir), "failure", "y_proba")
    long = curve.unpivot(["threshold"], ["precision", "recall", "f1"], "metric", "value")
    return long.where("metric <> 'f1'")


@query
def q_csv_panel(spark, sf_dir):
    """S1 + S2: the panel written as the study's CSV (Latin-1, its column names, some rows twice) and loaded again."""
    df, _ = panel(spark, sf_dir)
    raw = df.withColumnsRenamed({c: c.replace("m", "attribute", 1) for c in METRIC_COLS})
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/faultline-{uuid.uuid4().hex}"
    raw.unionByName(raw.where("failure = 1")).write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return load_panel(spark, path)[0]


@query
def q_csv_results(spark, sf_dir):
    """S3 + S4 + S5: a result table written as CSV under a stamped name, with its index, and read back without it."""
    share = stats.value_share(with_controls(spark, sf_dir)[0], "strt")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/faultline-{uuid.uuid4().hex}"
    path = write_result_csv(share.select(F.monotonically_increasing_id().alias("index"), "*"), base, "strata", best_id=0)
    return read_result_csv(spark, path, StructType([StructField("index", LongType()), *share.schema.fields]))
