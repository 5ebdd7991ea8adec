"""Ordered running sums without a single-task window.

``running_sums`` adds, for each row of a table keyed by an order column, the
sums of some count columns over all rows *before* it in that order (within its
group).  A window ``ORDER BY`` over everything would sort the table in one task;
instead Spark deals the rows into ranges of the order, as many as the table
needs, each range is summed in its own window, and the totals of a group's
earlier ranges (one row per group and range) are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut_lineage


def running_sums(df: DataFrame, order: str, cols: list[str], descending: bool = False,
                 by: list[str] | None = None, prefix: str = "before_") -> DataFrame:
    """Add ``before_<c>`` = sum of ``c`` over rows strictly earlier in ``order`` (within ``by``).

    ``order`` must be unique per row and group (aggregate to one row per order
    value first).  It is compared in its own type.  The ranges are written
    before they are used, so that all sums see the same ones.
    """
    by = list(by or [])
    key = F.col(order).desc() if descending else F.col(order).asc()
    x = cut_lineage(df.repartitionByRange(*[F.col(c) for c in by], key).withColumn("__r", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy(*by, "__r").agg(*[F.sum(c).alias(f"__t_{c}") for c in cols]).select(
        *by, "__r", *[F.coalesce(F.sum(f"__t_{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in cols])
    inside = Window.partitionBy(*by, "__r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = x.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__i_{c}") for c in cols])
    # A row per group and range; groups are a few columns or none, ranges are shuffle partitions.
    out = inner.join(F.broadcast(base), [*by, "__r"])
    return out.select(*df.columns, *[(F.col(f"__o_{c}") + F.col(f"__i_{c}")).alias(f"{prefix}{c}") for c in cols])
