"""Whole-column min-rank without a single-task window.

``rank(method='min') - 1`` of a value is the number of rows holding a smaller
value.  The plan:

1. unpivot the metrics and count rows per ``(metric, value)`` (map-side
   partial aggregation: a value held by a third of all rows becomes one row);
2. running sums of the counts by value (``prefix``): ranges of (metric, value),
   as many as the counts need, each summed in its own window;
3. look the offsets up in one skew-safe join for all metrics (``lookup``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.lookup import skew_safe_metric_lookup
from faultline.operators.prefix import running_sums
from faultline.session import cut_lineage


def _long_values(df: DataFrame, cols, ids=()) -> DataFrame:
    """Unpivoted values; columns of different whole-number types meet as bigint, others as double."""
    types = {df.schema[c].dataType.typeName() for c in cols}
    cast = None if len(types) == 1 else "bigint" if types <= {"byte", "short", "integer", "long"} else "double"
    sel = [F.col(c).cast(cast).alias(c) if cast else F.col(c) for c in cols]
    return df.select(*ids, *sel).unpivot(list(ids), list(cols), "metric", "v")


def rank_table(df: DataFrame, cols) -> DataFrame:
    """``(metric, v, cnt, below, n)``: rows per value, rows with a smaller value, rows in all.

    NULL values get one row with ``below`` NULL.  ``n`` counts all rows of ``df``.
    """
    cnt = cut_lineage(_long_values(df, cols).groupBy("metric", "v").agg(F.count(F.lit(1)).alias("cnt")))
    total = cnt.groupBy("metric").agg(F.sum("cnt").alias("n"))       # one row per metric
    ranked = running_sums(cnt.where(F.col("v").isNotNull()), "v", ["cnt"], by=["metric"]).withColumnRenamed("before_cnt", "below")
    missing = cnt.where(F.col("v").isNull()).withColumn("below", F.lit(None).cast("long"))
    return ranked.unionByName(missing).join(F.broadcast(total), "metric").select("metric", "v", "cnt", "below", "n")


def min_rank(df: DataFrame, cols, prefix_from: str = "m", prefix_to: str = "sr",
             table: DataFrame | None = None) -> DataFrame:
    """Add ``sr*`` = (min-rank - 1) / N for each column of ``cols``.

    The rank table (one row per distinct value) is written once.  Rows are
    looked up narrow: (row hash, metric, value) meets the table in one
    skew-safe join for all metrics, is regrouped by row, and joined back, so
    the number of shuffles does not depend on the number of metrics and wide
    rows move once.  Equal rows share a hash (128 bits) and have equal ranks.
    """
    table = cut_lineage(table if table is not None else rank_table(df, cols))
    every = [F.col(f"`{c}`") for c in df.columns]
    rows = df.withColumn("__row", F.struct(F.xxhash64(*every).alias("a"), F.xxhash64(F.lit("row"), *every).alias("b")))
    long = _long_values(rows, cols, ["__row"]).where(F.col("v").isNotNull())
    ranks = table.where(F.col("v").isNotNull()).select("metric", "v", "cnt", "n", (F.col("below") / F.col("n")).alias("x"))
    found = skew_safe_metric_lookup(long, ranks, ["x"], salt_from="__row")
    wide = found.groupBy("__row").agg(*[F.max(F.when(F.col("metric") == c, F.col("x"))).alias(c.replace(prefix_from, prefix_to, 1))
                                        for c in cols])
    return rows.join(wide, "__row", "left").drop("__row")


def apply_rank(df: DataFrame, table: DataFrame, c: str, name: str) -> DataFrame:
    """Rank new rows against a stored rank table (the fitted rows), F7 fit/apply.

    ``name`` = (fitted rows with a value strictly below v) / fitted N: an exact
    hit uses its ``below``; an unseen value uses the largest fitted value below
    it (``below + cnt``).  The distinct asked and fitted values are laid out in
    ranges, each range carries the last fitted value on, and one that begins
    without takes the last one of an earlier range.
    """
    fit = F.struct("v", "cnt", "below", "n").alias("fit")
    fitted = table.where((F.col("metric") == c) & F.col("v").isNotNull()).select("v", fit)
    if fitted.isEmpty():
        return df.withColumn(name, F.lit(None).cast("double"))
    asked = df.where(F.col(c).isNotNull()).select(F.col(c).alias("v")).distinct()
    both = fitted.unionByName(asked, allowMissingColumns=True).groupBy("v").agg(F.max("fit").alias("fit"))
    x = cut_lineage(both.repartitionByRange("v").withColumn("__r", F.spark_partition_id()))
    upto = Window.partitionBy("__r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)          # one row per range
    carry = (x.groupBy("__r").agg(F.max("fit").alias("f"))
             .select("__r", F.last("f", ignorenulls=True).over(earlier).alias("carry")))
    at = F.coalesce(F.last("fit", ignorenulls=True).over(upto), F.col("carry"))
    rank = (F.when(F.col("at").isNull(), F.lit(0.0))
            .when(F.col("at.v") == F.col("v"), F.col("at.below") / F.col("at.n"))
            .otherwise((F.col("at.below") + F.col("at.cnt")) / F.col("at.n")))
    ranks = x.join(F.broadcast(carry), "__r").withColumn("at", at).select(F.col("v").alias("__v"), rank.alias(name))
    return df.join(ranks, F.col(c) == F.col("__v"), "left").drop("__v")
