"""Aggregations A1-A6, A9-A11, A13-A16.

Each report is one partial/final hash aggregate over the panel; only the
report rows (classes x metrics) leave the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import isin_ns, np_round
from faultline.operators.clean import exclude_values


def value_share(df: DataFrame, col: str, name_cnt: str = "cnt", name_pct: str = "pct") -> DataFrame:
    """A1: rows per value (NULL dropped) and the value's share of rows, by count desc.

    The share is a window over the grouped rows (one row per distinct value).
    """
    counts = (df.where(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias(name_cnt)))
    return counts.withColumn(name_pct, F.col(name_cnt) / F.sum(name_cnt).over(Window.partitionBy()))


def target_share(df: DataFrame, col: str = "failure") -> DataFrame:
    """A2: count and percentage (x100, rounded to 2 like pandas) per label."""
    return (value_share(df, col, "count", "proportion")
            .withColumn("proportion", np_round(F.col("proportion") * 100, 2)))


def value_percentage(df: DataFrame, cols, by: str | None = None, values=(0,),
                     digits: int | None = 2, long: bool = True) -> DataFrame:
    """A3: per class of ``by`` (or one class ``total``), 100 x share of rows whose
    cell is in ``values``; the denominator counts every row, NULL cells included.

    ``long=True`` returns ``(by, m, pct)`` from one grouped aggregate over the
    unpivoted 0/1 flags; otherwise one column per metric (one wide aggregate).
    """
    key = by or "total"
    base = df if by else df.withColumn("total", F.lit("total"))

    def pct(v):
        v = F.avg(v) * 100
        return np_round(v, digits) if digits is not None else v

    flags = base.select(key, *[isin_ns(c, list(values)).cast("int").alias(c) for c in cols])
    if not long:
        return flags.groupBy(key).agg(*[pct(F.col(c)).alias(c) for c in cols])
    return (flags.unpivot([key], list(cols), "m", "hit")
            .groupBy(key, "m").agg(pct(F.col("hit")).alias("pct")))


def class_moments(df: DataFrame, cols, by: str, nonzero: bool = True) -> DataFrame:
    """A4 + A5 + R1: long ``(by, stat, m, value)`` of mean / sample std per class,
    and (``nonzero``) mean_nz / std_nz over values > 0.

    Rows are unpivoted to ``(by, m, x)`` and one grouped aggregate with four
    moments runs per (class, metric): small per-row code, one partial row per
    group and partition.
    """
    long = (df.where(F.col(by).isNotNull())
            .select(by, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([by], list(cols), "m", "x"))
    pos = F.when(F.col("x") > 0, F.col("x"))
    aggs = [F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")]
    if nonzero:
        aggs += [F.avg(pos).alias("mean_nz"), F.stddev_samp(pos).alias("std_nz")]
    stats = ["mean", "std"] + (["mean_nz", "std_nz"] if nonzero else [])
    g = long.groupBy(by, "m").agg(*aggs)
    return g.unpivot([by, "m"], stats, "stat", "value").select(by, "stat", "m", "value")


def category_counts(df: DataFrame, y: str | None, cols, proportion: bool = True) -> DataFrame:
    """A6 (+J3, R3): per listed column, rows per (value, class) as count or share of the class.

    Long ``(col, value, y, cnt|pct)``; every (value, class) pair seen in the data
    for that column is present, with 0 where the class has no row.  Equals the
    bar-chart sums of the study when no listed column is NULL.
    """
    ycol = y or "total"
    base = df if y else df.withColumn("total", F.lit(1))
    base = base.where(F.col(ycol).isNotNull())
    long = base.select(ycol, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        [ycol], list(cols), "col", "value")
    counts = long.groupBy("col", "value", ycol).agg(F.count(F.lit(1)).alias("cnt"))
    classes = base.groupBy(ycol).agg(F.count(F.lit(1)).alias("ycnt"))   # one row per class
    # The (value x class) grid of each column: an equi-join of two small grouped tables.
    by_col = classes.withColumn("col", F.explode(F.array(*[F.lit(c) for c in cols])))
    grid = counts.select("col", "value").distinct().join(by_col, "col")
    same = (F.col("g.col") == F.col("c.col")) & F.col("g.value").eqNullSafe(F.col("c.value")) & (F.col(f"g.{ycol}") == F.col(f"c.{ycol}"))
    out = (grid.alias("g").join(counts.alias("c"), same, "left")
           .select("g.col", "g.value", f"g.{ycol}", F.coalesce("c.cnt", F.lit(0)).cast("long").alias("cnt"), "g.ycnt"))
    if not proportion:
        return out.drop("ycnt")
    return out.withColumn("pct", F.col("cnt") / F.col("ycnt")).drop("ycnt", "cnt")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values (sort the result where its order matters)."""
    return df.select(col).distinct()


def dist_summary(df: DataFrame, cols, y: str | None = None, remove=(None,)) -> DataFrame:
    """Per metric (x class when ``y`` has >1 class) after excluding ``remove``:
    n, mean, sample std; ``n_total`` = rows kept over all classes of the metric."""
    ycol = y or "total"
    base = df if y else df.withColumn("total", F.lit("total"))
    long = base.select(ycol, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [ycol], list(cols), "m", "x")
    kept = long.where(exclude_values("x", list(remove)) & F.col(ycol).isNotNull())
    out = kept.groupBy("m", ycol).agg(F.count("x").alias("n"), F.avg("x").alias("mean"),
                                      F.stddev_samp("x").alias("std"))
    return out.withColumn("n_total", F.sum("n").over(Window.partitionBy("m")))


def score_range(df: DataFrame, score: str) -> DataFrame:
    """Max, min and spread of a score."""
    return df.agg(F.max(score).alias("max"), F.min(score).alias("min"),
                  (F.max(score) - F.min(score)).alias("range"))


def arg_best(df: DataFrame, score: str, key: str, largest: bool = True) -> DataFrame:
    """The key of the best score; ties go to the smallest key; NULL/NaN skipped."""
    s = F.col(score)
    ok = df.where(s.isNotNull() & ~F.isnan(s))
    order = F.struct((s if largest else -s).alias("s"), (-F.col(key)).alias("k"))
    return ok.agg(F.max_by(F.col(key), order).alias(key), F.max_by(s, order).alias(score))


def shape(df: DataFrame) -> DataFrame:
    """One row (rows, columns)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))
