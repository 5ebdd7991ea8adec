"""Pairwise Pearson correlation (A7), its display table (A8), duplicate test.

All column pairs are computed in one blocked matrix aggregate (pairwise-complete rows,
population moments), returned long as ``(a, b, corr)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import np_round
from faultline.operators.clean import value_filter
from faultline.operators.moments import correlation


def pearson_long(df: DataFrame, cols, remove_values=(None,)) -> DataFrame:
    """P7 filter, then corr for every ordered pair (diagonal included).

    One buffer of sums of outer products per task, whatever the number of pairs
    (``moments.pair_moments``).  A constant column gives NULL.
    """
    cols = list(cols)
    c = correlation(value_filter(df, cols, list(remove_values)), cols)
    rows = [(a, b, None if c[i, j] != c[i, j] else 1.0 if i == j else float(c[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")


def explode_cells(wide: DataFrame, structs) -> DataFrame:
    """Turn the one-row (or few-row) result of an aggregate into long rows, one pass."""
    return wide.select(F.inline(F.array(*structs)))


def corr_display(corr: DataFrame, cols) -> DataFrame:
    """Lower triangle (row after column) of round(corr, 2) x 100 as int, and its abs."""
    pos = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    lower = corr.where(pos[F.col("a")] > pos[F.col("b")])
    pct = (np_round(F.col("corr"), 2) * 100).cast("int")
    return lower.select("a", "b", pct.alias("corr100"), F.abs(pct).alias("abs100"))


def pair_differences(df: DataFrame, cols) -> DataFrame:
    """P6 evidence: rows where each pair of columns differs (null-safe), one pass."""
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = df.agg(*[F.sum((~F.col(a).eqNullSafe(F.col(b))).cast("long")).alias(f"d{k}")
                    for k, (a, b) in enumerate(pairs)])
    return explode_cells(wide, [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                                         F.coalesce(F.col(f"d{k}"), F.lit(0)).alias("n_diff"))
                                for k, (a, b) in enumerate(pairs)])
