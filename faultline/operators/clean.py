"""Projection, predicate and cleaning operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions import isin_ns
from faultline.schema import DUPLICATE_COLS, PanelSchema


def present(df: DataFrame, cols) -> list[str]:
    """The listed columns that exist in ``df``, in list order."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def insert_columns(df: DataFrame, position: int, **named: Column) -> DataFrame:
    """Add computed columns at ``position`` (pandas ``insert``), without mutation."""
    base = [c for c in df.columns if c not in named]
    order = base[:position] + list(named) + base[position:]
    return df.withColumns(named).select(*order)


def rename_substring(df: DataFrame, old: str, new: str, cols=None) -> DataFrame:
    """Replace ``old`` by ``new`` in the names of ``cols`` (default: all)."""
    cols = df.columns if cols is None else cols
    return df.withColumnsRenamed({c: c.replace(old, new) for c in cols if old in c})


def value_filter(df: DataFrame, cols, values, mode: str = "any_differs") -> DataFrame:
    """Remove rows holding the given values.

    ``any_differs`` (parity) keeps a row when *any* (column, value) term differs,
    i.e. terms are OR-ed: with one value only rows where every column equals it
    go; with two distinct values nothing goes.  ``all_differ`` ANDs the terms
    (a row goes when any listed column holds any listed value).  ``None`` values
    are skipped; no terms leaves the frame unchanged.  NULL cells count as
    different from every value.
    """
    terms = [~F.col(c).eqNullSafe(F.lit(v)) for c in cols for v in values if v is not None]
    if not terms:
        return df
    if mode == "any_differs":
        cond = reduce(lambda a, b: a | b, terms)
    elif mode == "all_differ":
        cond = reduce(lambda a, b: a & b, terms)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return df.where(cond)


def exclude_values(c, values) -> Column:
    """Predicate keeping cells not in ``values`` (NULL kept unless listed)."""
    listed_null = any(v is None for v in values)
    keep = ~isin_ns(c, values)
    return keep & F.col(c).isNotNull() if listed_null else keep


def drop_duplicate_columns(df: DataFrame, schema: PanelSchema, cols=None,
                           detect: bool = False) -> tuple[DataFrame, PanelSchema]:
    """Drop columns duplicating an earlier numeric column.

    ``detect=False`` drops the fixed list (``m8``); ``detect=True`` tests every
    ordered pair of numeric columns in one aggregate pass and drops each column
    that equals (null-safe) an earlier one on every row.
    """
    nums = list(schema.num_cols)
    if detect:
        drop = duplicate_columns(df, nums)
    else:
        drop = [c for c in (DUPLICATE_COLS if cols is None else cols) if c in df.columns]
    return df.drop(*drop), schema.with_(num_cols=tuple(c for c in nums if c not in drop))


def duplicate_columns(df: DataFrame, cols) -> list[str]:
    """Columns equal to an earlier column on every row (one aggregate, one row back)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return []
    aggs = [F.sum((~F.col(a).eqNullSafe(F.col(b))).cast("long")).alias(f"{a}|{b}") for a, b in pairs]
    row = df.agg(*aggs).first().asDict()
    dup = []
    for a, b in pairs:
        if row[f"{a}|{b}"] in (0, None) and a not in dup and b not in dup:
            dup.append(b)
    return dup


def rows_for_keys(df: DataFrame, keys: DataFrame, key_cols) -> DataFrame:
    """Rows of ``df`` whose key appears in ``keys`` (a semi join, no duplication)."""
    return df.join(keys.select(*key_cols), list(key_cols), "left_semi")
