"""Column transforms F9-F19: fit -> small parameter dict, apply -> Column expressions.

Fitting is one aggregate pass over the data (all columns at once); the fitted
parameters are a handful of numbers per column (quantile knots, scale, PCA
loadings), so applying them is a projection that stays in whole-stage codegen.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.columns import probit_text
from faultline.operators.moments import covariance
from faultline.operators.rank import rank_table
from faultline.session import cut_lineage

N_QUANTILES = 500
BOUNDS = 1e-7
# Normal-output clip bounds, ppf(1e-7 - eps) and ppf(1 - (1e-7 - eps)).
CLIP_MIN = -5.199337582605575
CLIP_MAX = 5.19933758270342


# ---- F9, F10 -------------------------------------------------------------------

def fit_scalers(df: DataFrame, minmax=(), normal=()) -> dict:
    """One aggregate for every scaled column: min/max, mean/population std."""
    aggs = []
    for c in minmax:
        aggs += [F.min(F.col(c).cast("double")).alias(f"min|{c}"), F.max(F.col(c).cast("double")).alias(f"max|{c}")]
    for c in normal:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"mean|{c}"),
                 F.stddev_pop(F.col(c).cast("double")).alias(f"std|{c}")]
    if not aggs:
        return {}
    row = df.agg(*aggs).first().asDict()
    params = {}
    for c in minmax:
        params[c] = ("mnmx", row[f"min|{c}"], row[f"max|{c}"])
    for c in normal:
        params[c] = ("nrm", row[f"mean|{c}"], row[f"std|{c}"])
    return params


def minmax_expr(c: str, lo: float, hi: float) -> Column:
    """(x - min) / (max - min); a constant column maps to 0."""
    rng = (hi - lo) if hi is not None and lo is not None else None
    scale = 1.0 if not rng else rng
    return (F.col(c).cast("double") - F.lit(lo)) / F.lit(scale)


def standard_expr(c: str, mean: float, std: float) -> Column:
    """(x - mean) / population std; std 0 divides by 1."""
    return (F.col(c).cast("double") - F.lit(mean)) / F.lit(std if std else 1.0)


# ---- F11 -------------------------------------------------------------------------

def fit_quantiles(df: DataFrame, cols, n_quantiles: int = N_QUANTILES) -> dict:
    """Exact linear-interpolation quantiles at ``linspace(0, 1, k)`` per column, k = min(n, 500).

    Values are counted and ranked once (``rank_table``); a value with ``below``
    smaller ones holds the sorted places below .. below + cnt - 1, so each value
    tells on its own which of the k quantiles lie between its places.  Only
    those values, two for each quantile at most, come to the driver.
    """
    cols = list(cols)
    clean = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols])
    table = cut_lineage(rank_table(clean, cols).where(F.col("v").isNotNull()).select("metric", "v", "cnt", "below"))
    n = {r.metric: r.n for r in table.groupBy("metric").agg(F.sum("cnt").alias("n")).collect()}
    refs = {c: [float(x) for x in np.linspace(0, 1, max(1, min(n_quantiles, n.get(c, 0))))] for c in cols}
    place = [(c, i, (n[c] - 1) * q) for c in n for i, q in enumerate(refs[c])]
    spark = df.sparkSession
    # k rows per column; every ranked value meets only those whose number its places can have.
    want = spark.createDataFrame([(c, i, math.floor(p), math.ceil(p)) for c, i, p in place] or [("", 0, 0, 0)],
                                 "metric string, i int, lo long, hi long")
    step = spark.createDataFrame([(c, float(len(refs[c]) - 1) / max(n[c] - 1, 1), len(refs[c]) - 1) for c in n] or [("", 0.0, 0)],
                                 "metric string, step double, last int")
    first = F.greatest(F.floor((F.col("below") - 1) * F.col("step")) - 1, F.lit(0)).cast("int")
    last = F.least(F.ceil((F.col("below") + F.col("cnt")) * F.col("step")) + 1, F.col("last")).cast("int")
    near = table.join(F.broadcast(step), "metric").withColumn("i", F.explode(F.sequence(first, F.greatest(first, last))))
    holds = lambda x: (F.col(x) >= F.col("below")) & (F.col(x) < F.col("below") + F.col("cnt"))
    got = (near.join(F.broadcast(want), ["metric", "i"]).where(holds("lo") | holds("hi"))
           .select("metric", "i", F.when(holds("lo"), F.col("v")).alias("a"), F.when(holds("hi"), F.col("v")).alias("b"))
           .groupBy("metric", "i").agg(F.max("a").alias("a"), F.max("b").alias("b")).collect())
    value = {(r.metric, r.i): (r.a, r.b) for r in got}
    out = {}
    for c in cols:
        knots = []
        for i, q in enumerate(refs[c]):
            p = (n.get(c, 1) - 1) * q
            a, b = value.get((c, i), (math.nan, math.nan))
            knots.append(a if math.floor(p) == math.ceil(p) or a == b else (math.ceil(p) - p) * a + (p - math.floor(p)) * b)
        out[c] = ("qt", knots, refs[c])
    return out


def quantile_uniform(df: DataFrame, c: str, knots: list, refs: list, out: str) -> DataFrame:
    """F11 apply, first stage: add ``out`` = position in [0, 1] of ``c``.

    The mean of forward and backward interpolation on the knots: a run of equal
    knots resolves to the middle of its references, values between runs
    interpolate linearly, values within 1e-7 of the outer knots map to 0 / 1.
    The bracketing run is found by a binary search (``Bucketizer`` on the
    distinct knots), then read from literal arrays.
    """
    from pyspark.ml.feature import Bucketizer
    uq, first, last = [], [], []
    for i, v in enumerate(knots):
        if uq and v == uq[-1]:
            last[-1] = i
        else:
            uq.append(float(v)); first.append(i); last.append(i)
    n, m = len(uq), len(refs)
    tmp, b = f"__x_{out}", f"__b_{out}"
    staged = df.withColumn(tmp, F.expr(f"coalesce(CASE WHEN NOT isnan(CAST(`{c}` AS DOUBLE)) "
                                       f"THEN CAST(`{c}` AS DOUBLE) END, 0D)"))
    staged = Bucketizer(splits=[-math.inf] + uq + [math.inf], inputCol=tmp, outputCol=b).transform(staged)
    # One row per bucket (at most n_quantiles rows): the run below x and the knot above it.
    rows = []
    for k in range(1, n + 1):
        lo_last = last[k - 1]
        rows.append((k, uq[k - 1], uq[min(k, n - 1)], (refs[lo_last] + refs[first[k - 1]]) / 2,
                     refs[lo_last], refs[min(lo_last + 1, m - 1)]))
    spark = df.sparkSession
    knots_t = spark.createDataFrame(
        rows, f"`{b}` int, __lo double, __hi double, __mid double, __rlo double, __rhi double")
    j = staged.withColumn(b, F.col(b).cast("int")).join(F.broadcast(knots_t), b, "left")
    x = f"CAST(`{c}` AS DOUBLE)"
    u = (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN {x} "
         f"WHEN {x} - {BOUNDS!r}D < {float(knots[0])!r}D THEN 0D "
         f"WHEN {x} + {BOUNDS!r}D > {float(knots[-1])!r}D THEN 1D "
         f"WHEN {x} = __lo THEN __mid "
         f"ELSE __rlo + ({x} - __lo) * try_divide(__rhi - __rlo, __hi - __lo) END")
    return j.withColumn(out, F.expr(u)).drop(tmp, b, "__lo", "__hi", "__mid", "__rlo", "__rhi")


def _np_list(values) -> list:
    return [float(v) for v in values]


def normal_score(df: DataFrame, name: str, out: str) -> DataFrame:
    """F11 apply, second stage: ``out`` = clipped standard normal quantile of ``name``.

    The two AS 241 intermediates are staged as columns so the polynomial
    expressions reference them instead of repeating them.
    """
    lo, hi = f"{CLIP_MIN!r}D", f"{CLIP_MAX!r}D"
    u = f"`{name}`"
    q, r = f"`{name}_q`", f"`{name}_r`"
    staged = df.withColumns({
        f"{name}_q": F.expr(f"{u} - 0.5D"),
        f"{name}_r": F.expr(f"CASE WHEN {u} > 0 AND {u} < 1 THEN sqrt(-ln(CASE WHEN {u} <= 0.5D THEN {u} "
                            f"ELSE 1D - {u} END)) END")})
    z = f"CASE WHEN {u} <= 0 THEN {lo} WHEN {u} >= 1 THEN {hi} ELSE {probit_text(u, q=q, r=r)} END"
    return (staged.withColumn(out, F.expr(f"CASE WHEN {u} IS NULL THEN NULL "
                                          f"ELSE least(greatest({z}, {lo}), {hi}) END"))
            .drop(f"{name}_q", f"{name}_r"))


# ---- F12 -----------------------------------------------------------------------

def yeo_johnson_expr(x: Column, lam: float) -> Column:
    """Yeo-Johnson transform of ``x`` with a fixed lambda."""
    pos = (F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam)
    neg = (-F.log1p(-x) if abs(lam - 2) < 1e-12
           else -(F.pow(-x + 1, F.lit(2 - lam)) - 1) / (2 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_values(x: np.ndarray, lam: float) -> np.ndarray:
    """``yeo_johnson_expr`` of an array."""
    out, low = np.empty_like(x), ~(x >= 0)
    up = x[~low]
    out[~low] = np.log1p(up) if abs(lam) < 1e-12 else (np.power(up + 1, lam) - 1) / lam
    out[low] = -np.log1p(-x[low]) if abs(lam - 2) < 1e-12 else -(np.power(1 - x[low], 2 - lam) - 1) / (2 - lam)
    return out


def _yj_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(c, x, n)``: how often each column (by its place) has each value, written once for all passes."""
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(str(i)) for i, c in enumerate(cols)]).unpivot([], [str(i) for i in range(len(cols))], "c", "x")
    return cut_lineage(long.where("x IS NOT NULL").groupBy(F.col("c").cast("int").alias("c"), "x").agg(F.count(F.lit(1)).alias("n")))


def _joined(n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> tuple:
    """Count, mean and summed squares around it of parts, one per row, put together."""
    with np.errstate(all="ignore"):
        at = mean[0] + (n[:, None] * (mean - mean[0])).sum(0) / n.sum()             # equal means stay as they are
        return n.sum(), at, (m2 + n[:, None] * (mean - at) ** 2).sum(0)


def _yj_llf(values: DataFrame, cols: list[str], grids: dict) -> dict:
    """Log-likelihood of every (column, lambda) in ``grids`` from ``_yj_table``: one pass, a row per task and column is added up."""
    schema = T.StructType.fromDDL("c int, n double, s double, mean binary, m2 binary")
    of = {cols.index(c): lams for c, lams in grids.items()}

    def rows_of(found: dict):
        import pyarrow as pa
        return [pa.array(list(found), pa.int32()), *[pa.array([float(v[i]) for v in found.values()]) for i in (0, 1)],
                *[pa.array([v[i].tobytes() for v in found.values()], pa.binary()) for i in (2, 3)]]

    def add(batches):
        import pyarrow as pa
        found = {}
        for b in batches:
            c, x, n = (b.column(i).to_numpy() for i in range(3))
            for i in np.unique(c).tolist():
                if i not in of:
                    continue
                v, w = x[c == i], n[c == i].astype(float)
                with np.errstate(all="ignore"):
                    s = float((w * np.sign(v) * np.log1p(np.abs(v))).sum())
                    mean, m2 = np.empty(len(of[i])), np.empty(len(of[i]))
                    for j, lam in enumerate(of[i]):
                        y = yeo_johnson_values(v, lam)
                        mean[j] = y[0] + (w * (y - y[0])).sum() / w.sum()                   # a constant has no variance at all
                        m2[j] = (w * (y - mean[j]) ** 2).sum()
                if i in found:
                    k, t, a, q = found[i]
                    found[i] = (_joined(np.array([k, w.sum()]), np.stack([a, mean]), np.stack([q, m2])))
                    found[i] = (found[i][0], t + s, *found[i][1:])
                else:
                    found[i] = (w.sum(), s, mean, m2)
        if found:
            yield pa.RecordBatch.from_arrays(rows_of(found), names=schema.names)

    def join(key, table):
        import pyarrow as pa
        parts = sorted(zip(*(table.column(c).to_pylist() for c in schema.names[1:]), strict=True))
        n, mean, m2 = _joined(np.array([p[0] for p in parts]), *(np.stack([np.frombuffer(p[i], float) for p in parts]) for i in (2, 3)))
        return pa.Table.from_arrays(rows_of({key[0].as_py(): (n, sum(p[1] for p in parts), mean, m2)}), names=schema.names)

    told = {r.c: r for r in values.mapInArrow(add, schema).groupBy("c").applyInArrow(join, schema).collect()}          # a row per column
    out = {}
    for c, lams in grids.items():
        r = told.get(cols.index(c))
        var = np.full(len(lams), np.nan) if r is None else np.frombuffer(bytes(r.m2), float) / r.n
        out[c] = [-math.inf if not 0 < v < math.inf else -r.n / 2 * math.log(v) + (lam - 1) * r.s for v, lam in zip(var.tolist(), lams, strict=True)]
    return out


def fit_yeo_johnson(df: DataFrame, cols, lo: float = -4.0, hi: float = 4.0,
                    points: int = 41, rounds: int = 4) -> dict:
    """Max-likelihood lambda per column by successive grid refinement; each
    round is one pass over the columns' different values.

    A column whose best lambda is at an end of the first grid gets a grid twice
    as wide, again and again, until the best one lies inside, or beyond 2048, where powers
    of any value but 0 leave the range of a double.  A constant column keeps lambda 1.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    values = _yj_table(df, cols)
    span = {c: (lo, hi) for c in cols}
    best = {c: 0.0 for c in cols}
    inside, left = set(), dict.fromkeys(cols, rounds)
    while span:
        grids = {c: [float(v) for v in np.linspace(a, b, points)] for c, (a, b) in span.items()}
        llf = _yj_llf(values, cols, grids)
        for c, (a, b) in list(span.items()):
            i = int(np.argmax(llf[c]))
            if not max(llf[c]) > -math.inf:
                best[c] = 1.0
                del span[c]
                continue
            best[c] = grids[c][i]
            if c not in inside and i in (0, points - 1) and b - a < 1 << 12:
                span[c] = (2 * a, 2 * b)
                continue
            inside.add(c)
            step = (b - a) / (points - 1)
            span[c] = (best[c] - step, best[c] + step)
            left[c] -= 1
            if not left[c]:
                del span[c]
    return best


def fit_power(df: DataFrame, cols, standardize: bool = True) -> dict:
    cols = list(cols)
    lams = fit_yeo_johnson(df, cols)
    stats = {}
    if standardize:
        aggs = []
        for c in cols:
            y = yeo_johnson_expr(F.col(c).cast("double"), lams[c])
            aggs += [F.avg(y).alias(f"m|{c}"), F.stddev_pop(y).alias(f"s|{c}")]
        row = df.agg(*aggs).first().asDict()
        stats = {c: (row[f"m|{c}"], row[f"s|{c}"]) for c in cols}
    return {c: ("yj", lams[c], *(stats.get(c, (None, None)))) for c in cols}


def power_expr(c: str, lam: float, mean, std) -> Column:
    """F12 apply: Yeo-Johnson, then (optionally) standardise."""
    y = yeo_johnson_expr(F.col(c).cast("double"), lam)
    return y if mean is None else (y - F.lit(mean)) / F.lit(std if std else 1.0)


# ---- F13 ---------------------------------------------------------------------

def fit_transforms(df: DataFrame, plan: dict) -> dict:
    """F13 fit: ``{column: code}`` with codes yj, qt, nrm, mnmx, none -> parameters."""
    by = {}
    for c, code in plan.items():
        by.setdefault(code, []).append(c)
    params = {}
    params.update(fit_scalers(df, minmax=by.get("mnmx", ()), normal=by.get("nrm", ())))
    if by.get("qt"):
        params.update(fit_quantiles(df, by["qt"]))
    if by.get("yj"):
        params.update(fit_power(df, by["yj"]))
    for c in by.get("none", ()):
        params[c] = ("none",)
    return params


def transform_expr(c: str, p: tuple) -> Column:
    code = p[0]
    if code == "mnmx":
        return minmax_expr(c, p[1], p[2])
    if code == "nrm":
        return standard_expr(c, p[1], p[2])
    if code == "qt":
        raise ValueError("quantile columns are applied by apply_transforms (two stages)")
    if code == "yj":
        return power_expr(c, p[1], p[2], p[3])
    return F.col(c)


def apply_transforms(df: DataFrame, params: dict) -> DataFrame:
    """F13 apply: projections replacing each planned column.

    Quantile columns go through a staged column (the uniform position) so the
    normal-quantile polynomial references a column, not the interpolation.
    """
    qt = {c: p for c, p in params.items() if p[0] == "qt"}
    staged = df
    for c, p in qt.items():
        staged = quantile_uniform(staged, c, p[1], p[2], f"__u_{c}")
        staged = normal_score(staged, f"__u_{c}", f"__z_{c}")
    out = staged.withColumns({c: (F.col(f"__z_{c}") if p[0] == "qt" else transform_expr(c, p))
                              for c, p in params.items()})
    return out.drop(*[f"__u_{c}" for c in qt], *[f"__z_{c}" for c in qt])


# ---- F14, F15 --------------------------------------------------------------------

def fit_pca(df: DataFrame, cols) -> dict:
    """F14 fit: centred, unscaled PCA with K = #columns.

    The d x d covariance (d = #columns) is one blocked matrix aggregate (``moments``); its eigenvectors
    are computed on the driver (a d x d matrix, independent of the row count).
    Each component's sign makes its largest-magnitude loading positive.
    """
    cols = list(cols)
    d = len(cols)
    mu, cov = covariance(df, cols)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0, None), vecs[:, order]
    for k in range(d):
        if vecs[np.argmax(np.abs(vecs[:, k])), k] < 0:
            vecs[:, k] = -vecs[:, k]
    total = vals.sum()
    ratio = (vals / total) if total > 0 else np.zeros(d)
    return {"cols": cols, "mean": mu.tolist(), "components": vecs.T.tolist(),
            "variance": vals.tolist(), "ratio": ratio.tolist(),
            "names": [f"pc{k + 1}" for k in range(d)]}


def apply_pca(df: DataFrame, model: dict, keep=()) -> DataFrame:
    """F14 apply: scores pc1..pcK as linear Column expressions of the centred columns."""
    cols, mu = model["cols"], model["mean"]
    centred = [F.col(c).cast("double") - F.lit(m) for c, m in zip(cols, mu)]
    scores = []
    for name, comp in zip(model["names"], model["components"]):
        expr = None
        for w, xc in zip(comp, centred):
            term = xc * F.lit(float(w))
            expr = term if expr is None else expr + term
        scores.append(expr.alias(name))
    return df.select(*keep, *scores)


def scree_table(spark, model: dict) -> DataFrame:
    """``(component, k, var, cumvar)`` from the fitted ratios (d rows)."""
    rows = [(n, k + 1, float(v)) for k, (n, v) in enumerate(zip(model["names"], model["ratio"]))]
    from pyspark.sql import Window
    t = spark.createDataFrame(rows, "component string, k int, var double")
    w = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("cumvar", F.sum("var").over(w))


# ---- F16, F17 ----------------------------------------------------------------

def fit_one_hot(df: DataFrame, cols) -> dict:
    """F16 fit: sorted categories per column (one unpivot + distinct pass).

    Numeric columns sort numerically, strings lexically; the first is dropped.
    Every category becomes a column name, so the fitted list is as large as the
    plan that uses it; ``one_hot_long`` needs no such list.
    """
    cols = list(cols)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "c", "v")
    cats = long.where(F.col("v").isNotNull()).distinct()
    rows = cats.collect()
    numeric = {c for c in cols if df.schema[c].dataType.typeName() in ("integer", "long", "short", "byte")}
    out = {c: [] for c in cols}
    for r in rows:
        out[r["c"]].append(r["v"])
    for c in cols:
        out[c] = sorted(out[c], key=(lambda v: int(v)) if c in numeric else None)
    return out


def apply_one_hot(df: DataFrame, cats: dict) -> list[Column]:
    """F16 apply: a 0/1 column per fitted category but the first; a category that was not fitted fails the query, NULL is 0 everywhere."""
    out = []
    for c, vals in cats.items():
        v = F.col(c).cast("string")
        known = F.when(v.isNull() | v.isin(vals), v).otherwise(
            F.raise_error(F.concat(F.lit(f"{c} has a category that was not fitted: "), v)).cast("string"))
        out += [F.coalesce(known == F.lit(x), F.lit(False)).cast("int").alias(f"{c}_{x}") for x in vals[1:]]
    return out


def one_hot_names(cats: dict) -> list[str]:
    return [f"{c}_{v}" for c, vals in cats.items() for v in vals[1:]]


def one_hot_long(df: DataFrame, cols, key_cols) -> DataFrame:
    """F16 as sparse long rows ``(key.., feature)`` for cells equal to 1.

    Category order is computed in Spark (dense_rank per column), so no
    driver round trip: a cell maps to ``col_value`` unless it is its column's
    first category.
    """
    from pyspark.sql import Window
    cols = list(cols)
    long = df.select(*key_cols, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        list(key_cols), cols, "c", "v").where(F.col("v").isNotNull())
    numeric = [c for c in cols if df.schema[c].dataType.typeName() in ("integer", "long", "short", "byte")]
    sort_num = F.when(F.col("c").isin(numeric) if numeric else F.lit(False), F.col("v").cast("long"))
    first = (long.groupBy("c").agg(F.min(F.struct(sort_num.alias("n"), F.col("v").alias("v"))).alias("f"))
             .select("c", F.col("f.v").alias("first")))
    return (long.join(F.broadcast(first), "c").where(F.col("v") != F.col("first"))
            .select(*key_cols, F.concat_ws("_", "c", "v").alias("feature")))
