"""Spark queries against their DuckDB SQL on the sf0.01 test tables."""

import math
from collections import Counter

import duckdb
import pytest

from conftest import SF01

FAST = ["q_panel", "q_target_share", "q_strata_share", "q_zero_pct", "q_full_zero_pct",
        "q_nonzero_stats", "q_filter_any", "q_filter_all", "q_device_features", "q_date_features",
        "q_category_share", "q_elapsed", "q_elapsed_global_fill", "q_change", "q_change_inf_pct",
        "q_switch", "q_switch_pct", "q_rank", "q_rank_aggs", "q_corr", "q_corr_display",
        "q_dup_columns", "q_dist_summary", "q_density", "q_undersample_counts", "q_undersample",
        "q_undersample_ratio", "q_split", "q_split_balance", "q_folds", "q_bags", "q_bag_coverage",
        "q_minmax", "q_standard", "q_quantile", "q_features", "q_one_hot", "q_transform",
        "q_confusion", "q_scores", "q_pr_curve", "q_best_threshold", "q_auc", "q_threshold_sweep",
        "q_rug_sample", "q_bootstrap", "q_pca_trace", "q_distinct_levels", "q_score_range",
        "q_best_day_metric", "q_shape", "q_undersample_counts_cv", "q_yeo_johnson", "q_pca", "q_scree", "q_prepared",
        "q_tree_stump", "q_rename", "q_rows_for_keys", "q_abbreviated", "q_strata_scores", "q_pr_points", "q_csv_panel", "q_csv_results"]


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return str(v)
        return float(f"{v:.10g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["events"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con


def test_every_query_has_sql_or_is_model_based():
    from __spark_entry__ import oracle_sql, queries
    missing = {q for q in set(queries()) - set(oracle_sql()) if q.startswith("q_")}
    assert missing <= {"q_bag_logistic", "q_bag_logistic_ratio", "q_bag_forest", "q_bag_boost", "q_bag_forest_ratio", "q_bag_boost_ratio",
                       "q_search_table", "q_search_boost_table", "q_search_best", "q_param_marginals", "q_ablation_table", "q_candidate_scores", "q_bag_draws"}, missing


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, duck, name):
    from __spark_entry__ import oracle_sql, queries
    sdf = queries()[name](spark, SF01)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert _bag(sdf.columns, srows) == _bag(dcols, res.fetchall())
