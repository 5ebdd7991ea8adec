"""Scalar Column expressions (X1-X16, A10) — all JVM-side, no Python UDFs."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_of", "isin_ns", "np_round", "month_week", "weekend",
    "row_sum", "row_mean", "row_max", "abbreviate", "ratio_label", "label_at",
    "strata_to_target", "probit", "hash_order", "hash_fraction", "stamp",
    "nan_to_null", "INF", "lit_array",
]

INF = float("inf")


def lit_array(values, kind: str = "double") -> Column:
    """A literal array built from one SQL expression (one call, not one per element)."""
    if kind == "double":
        body = ", ".join(f"CAST('{float(v)!r}' AS DOUBLE)" if not math.isfinite(float(v))
                         else f"{float(v)!r}D" for v in values)
    else:
        body = ", ".join(str(int(v)) for v in values)
    return F.expr(f"array({body})")


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def isin_ns(c, values) -> Column:
    """Membership that is False (not NULL) for NULL input, like pandas ``isin``.

    NaN in ``values`` matches NaN cells (Spark treats NaN = NaN as true).
    """
    values = [v for v in values if v is not None]
    c = col_of(c)
    if not values:
        return F.lit(False)
    return F.coalesce(c.isin(*values), F.lit(False))


def np_round(c, digits: int = 2) -> Column:
    """numpy/pandas ``round``: scale, round half to even, unscale (binary double)."""
    scale = float(10 ** digits)
    return F.rint(col_of(c) * F.lit(scale)) / F.lit(scale)


def month_week(day) -> Column:
    """Week of month as floor(D / 8) + 1 (1-7 -> 1, 8-15 -> 2, 16-23 -> 3, 24-31 -> 4)."""
    return (F.floor(col_of(day) / F.lit(8)) + F.lit(1)).cast("int")


def weekend(weekday) -> Column:
    """1 when the Monday-0 weekday is Saturday or Sunday."""
    return (col_of(weekday) > F.lit(4)).cast("int")


def row_sum(cols) -> Column:
    """A10: row-wise sum skipping NULL (0 for an all-NULL row)."""
    return reduce(lambda a, b: a + b, [F.coalesce(col_of(c), F.lit(0)) for c in cols])


def row_mean(cols) -> Column:
    """A10: row-wise mean over non-NULL cells; NULL when all are NULL."""
    n = reduce(lambda a, b: a + b, [col_of(c).isNotNull().cast("int") for c in cols])
    s = reduce(lambda a, b: a + b, [F.coalesce(col_of(c).cast("double"), F.lit(0.0)) for c in cols])
    return F.try_divide(s, n)


def row_max(cols) -> Column:
    """A10: row-wise max skipping NULL."""
    cols = [col_of(c) for c in cols]
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def nan_to_null(c) -> Column:
    c = col_of(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


# Magnitude suffixes of the number abbreviation.
SUFFIXES = ["", "K", "M", "G", "T", "P"]


def abbreviate(c, is_integral: bool) -> Column:
    """Readable number, e.g. 1234 -> '1.23K'; integers below 1000 print as is.

    ``is_integral`` is the column's type (known on the driver from the schema).
    """
    c = col_of(c)
    a = F.abs(c.cast("double"))
    k = reduce(lambda x, y: x + y,
               [(a >= F.lit(1000.0 ** i)).cast("int") for i in range(1, len(SUFFIXES))])
    scaled = c.cast("double") / F.pow(F.lit(1000.0), k)
    text = F.format_string("%.2f%s", scaled, F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), k + 1))
    if is_integral:
        return F.when(c < 1000, c.cast("string")).otherwise(text)
    return text


def ratio_label(p0, p1, p2) -> Column:
    """X10: 'a:b:c' of three proportions as truncated percentages."""
    return F.concat_ws(":", *[(col_of(p) * 100).cast("int").cast("string") for p in (p0, p1, p2)])


def label_at(score, threshold) -> Column:
    """1 when score >= threshold else 0."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (col_of(score) >= t).cast("int")


def strata_to_target(strt) -> Column:
    """Stratum 2 is the failing class."""
    return (col_of(strt) == 2).cast("int")


# Wichura (1988), Algorithm AS 241 (PPND16), highest power first.
_AS241_A = [2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4,
            4.5921953931549871457e+4, 1.3731693765509461125e+4, 1.9715909503065514427e+3,
            1.3314166789178437745e+2, 3.3871328727963666080e+0]
_AS241_B = [5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4,
            2.1213794301586595867e+4, 5.3941960214247511077e+3, 6.8718700749205790830e+2,
            4.2313330701600911252e+1, 1.0]
_AS241_C = [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
            1.27045825245236838258e+0, 3.64784832476320460504e+0, 5.76949722146069140550e+0,
            4.63033784615654529590e+0, 1.42343711074968357734e+0]
_AS241_D = [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
            1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e+0,
            2.05319162663775882187e+0, 1.0]
_AS241_E = [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
            2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e+0,
            5.46378491116411436990e+0, 6.65790464350110377720e+0]
_AS241_F = [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
            7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
            5.99832206555887937690e-1, 1.0]


def _horner_text(coefs, x: str, num) -> str:
    acc = num(coefs[0])
    for a in coefs[1:]:
        acc = f"({acc} * {x} + {num(a)})"
    return acc


def probit_text(p: str, num=lambda v: f"{float(v)!r}D", q: str | None = None, r: str | None = None) -> str:
    """AS 241 as SQL text over the SQL expression ``p``.

    ``num`` formats a double literal (Spark: ``1.5D``; DuckDB: ``1.5e0``), so the
    same text serves the Spark plan and the DuckDB oracle.
    """
    q = q or f"({p} - {num(0.5)})"
    r0 = f"({num(0.180625)} - {q} * {q})"
    central = f"({q} * {_horner_text(_AS241_A, r0, num)} / {_horner_text(_AS241_B, r0, num)})"
    r = r or f"sqrt(-ln(CASE WHEN {q} <= 0 THEN {p} ELSE {num(1.0)} - {p} END))"
    rn, rf = f"({r} - {num(1.6)})", f"({r} - {num(5.0)})"
    near = f"({_horner_text(_AS241_C, rn, num)} / {_horner_text(_AS241_D, rn, num)})"
    far = f"({_horner_text(_AS241_E, rf, num)} / {_horner_text(_AS241_F, rf, num)})"
    tail = f"(CASE WHEN {r} <= {num(5.0)} THEN {near} ELSE {far} END)"
    return (f"(CASE WHEN abs({q}) <= {num(0.425)} THEN {central} "
            f"ELSE (CASE WHEN {q} < 0 THEN -{tail} ELSE {tail} END) END)")


def probit(name: str) -> Column:
    """Standard normal quantile of the double column ``name`` (values in (0, 1)), AS 241.

    Built from SQL text in one call; the column is referenced, not inlined.
    """
    return F.expr(probit_text(f"`{name}`"))


def hash_order(seed, *cols) -> Column:
    """Seeded random order key: hex md5 of ``seed:c1:c2..`` (same text in DuckDB); a NULL part counts as ``\\N``."""
    parts = [F.lit(str(seed))]
    for c in cols:
        parts += [F.lit(":"), F.coalesce(col_of(c).cast("string"), F.lit("\\N"))]
    return F.md5(F.concat(*parts))


def hash_fraction(hex_md5) -> Column:
    """Uniform [0, 1) value from the first 13 hex digits of a hex md5."""
    return F.conv(F.substring(col_of(hex_md5), 1, 13), 16, 10).cast("double") / F.lit(float(16 ** 13))


def stamp(ts=None) -> Column:
    """``yyyyMMdd_HHmm`` text of a timestamp (default: now)."""
    return F.date_format(col_of(ts) if ts is not None else F.current_timestamp(), "yyyyMMdd_HHmm")
