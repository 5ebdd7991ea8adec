"""Moments of many columns at once (A7, F14, F18): one blocked matrix aggregate.

Each task adds up the outer products of its rows, a batch at a time, into one d x d
buffer per moment, and hands on one row; these are added in a few tasks, so what comes
to the driver is d x d numbers, whatever the rows.  Values are shifted by the
columns' means first (one narrow aggregate), so sums of products lose no digits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.forest import _matrix, feature_array

ADDERS = 8                        # tasks that add up the others' buffers
ONE = T.StructType([T.StructField("m", T.BinaryType())])


def pair_moments(df: DataFrame, cols) -> tuple[np.ndarray, np.ndarray]:
    """``(shift, m)``: m[0] counts the rows where both columns have a value, m[1][a, b] adds up a over them (less its
    shift), m[2] products, m[3] squares of a.  NaN counts as no value."""
    cols = list(cols)
    d = len(cols)
    means = df.agg(*[F.avg(F.when(~F.isnan(x), x)) for x in (F.col(c).cast("double") for c in cols)]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])

    def add(batches):
        import pyarrow as pa
        m = np.zeros((4, d, d))
        for b in batches:
            x = _matrix(b.column(0), d) - shift
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            has = there.astype(float)
            m += np.stack([has.T @ has, x.T @ has, x.T @ x, (x * x).T @ has])
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["m"])

    def merge(batches):
        import pyarrow as pa
        m = np.zeros(4 * d * d)
        for b in batches:
            for x in b.column(0).to_pylist():
                m += np.frombuffer(x, float)
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["m"])

    parts = df.select(feature_array(cols).alias("v")).mapInArrow(add, ONE).repartition(ADDERS).mapInArrow(merge, ONE).collect()
    total = sum((np.frombuffer(bytes(p["m"]), float) for p in parts), np.zeros(4 * d * d))
    return shift, total.reshape(4, d, d)


def correlation(df: DataFrame, cols) -> np.ndarray:
    """Pearson correlation of every pair over the rows that have both; NaN where a column is constant."""
    _, (n, s, p, q) = pair_moments(df, cols)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = s / n
        var = np.maximum(q / n - mean * mean, 0)
        scale = np.sqrt(var * var.T)
        return np.where(scale > 0, (p / n - mean * mean.T) / scale, np.nan)


def covariance(df: DataFrame, cols) -> tuple[np.ndarray, np.ndarray]:
    """Means, and sample covariances of every pair over the rows that have both (0 for fewer than two)."""
    shift, (n, s, p, _) = pair_moments(df, cols)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = shift + np.where(np.diag(n) > 0, np.diag(s) / np.diag(n), 0.0)
        cov = (p - s * s.T / n) / (n - 1)
    return mean, np.where(n > 1, cov, 0.0)
