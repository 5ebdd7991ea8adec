"""Gaussian kernel density on a grid (A12), per metric and class.

Bandwidth follows Scott's rule (sample std x n^-1/5); the grid spans
[min - 3h, max + 3h] in ``points`` steps.  Rows are first collapsed to
``(metric, class, value, count)``; each distinct value then adds its weight to
the grid points, to all of them unless the caller gives a ``tail`` in
bandwidths, so the work per value is bounded by ``points``.
``bins`` optionally rounds values to a fixed number of bins per metric first,
bounding the work by ``bins x points`` regardless of the data size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators.clean import exclude_values

GRID_POINTS = 200
CUT = 3.0


def density_grid(df: DataFrame, cols, y: str | None = None, remove=(None,),
                 points: int = GRID_POINTS, bins: int | None = None, tail: float | None = None) -> DataFrame:
    """``(m, y, k, x, density)`` for k in 0..points-1."""
    ycol = y or "total"
    base = df if y else df.withColumn("total", F.lit("total"))
    long = (base.select(ycol, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([ycol], list(cols), "m", "v")
            .where(exclude_values("v", list(remove)) & F.col("v").isNotNull()
                   & F.col(ycol).isNotNull()))
    vals = long.groupBy("m", ycol, "v").agg(F.count(F.lit(1)).alias("w"))
    st = (long.groupBy("m", ycol).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"),
        F.stddev_samp("v").alias("sd"))
        .withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
        .where(F.col("h") > 0)
        .withColumn("lo", F.col("vmin") - CUT * F.col("h"))
        .withColumn("step", (F.col("vmax") - F.col("vmin") + 2 * CUT * F.col("h")) / (points - 1))
        .select("m", ycol, "n", "h", "lo", "step"))
    if bins:
        vals = (vals.join(F.broadcast(st), ["m", ycol])
                .withColumn("v", F.col("lo") + F.round((F.col("v") - F.col("lo")) / (F.col("step") * points / bins))
                            * (F.col("step") * points / bins))
                .groupBy("m", ycol, "v").agg(F.sum("w").alias("w")))
    # metrics x classes rows: bounded, broadcast.
    j = vals.join(F.broadcast(st), ["m", ycol])
    k0, k1 = F.lit(0), F.lit(points - 1)
    if tail is not None:
        k0 = F.greatest(k0, F.ceil((F.col("v") - tail * F.col("h") - F.col("lo")) / F.col("step")))
        k1 = F.least(k1, F.floor((F.col("v") + tail * F.col("h") - F.col("lo")) / F.col("step")))
    contrib = (j.withColumn("k", F.explode(F.sequence(k0.cast("int"), k1.cast("int"))))
               .withColumn("g", F.col("lo") + F.col("k") * F.col("step"))
               .withColumn("z", (F.col("g") - F.col("v")) / F.col("h"))
               .select("m", ycol, "k", (F.col("w") * F.exp(-0.5 * F.col("z") * F.col("z"))
                                        / (F.col("h") * F.col("n") * math.sqrt(2 * math.pi))).alias("d")))
    zeros = (st.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
             .select("m", ycol, "k", F.lit(0.0).alias("d")))
    dens = contrib.unionByName(zeros).groupBy("m", ycol, "k").agg(F.sum("d").alias("density"))
    return (dens.join(F.broadcast(st.select("m", ycol, "lo", "step")), ["m", ycol])
            .select("m", ycol, "k", (F.col("lo") + F.col("k") * F.col("step")).alias("x"), "density"))
