"""Feature operators F1-F8 and the per-device windows W1-W4.

All per-device work shares one window spec, so Spark plans a single shuffle
on ``device`` plus one sort for elapsed days, change, and switch metrics of
every metric.  A device has at most one row per day, so device partitions are
bounded by the number of days whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import INF, month_week, row_max, row_mean, row_sum, weekend
from faultline.operators.clean import drop_duplicate_columns, present
from faultline.operators.rank import min_rank
from faultline.schema import (CHANGE_DROP, DEVICE_LEVELS, METRIC_COLS, RANK_DROP, TARGET_COL,
                              ZERO_DENSE_COLS, PanelSchema)
from faultline.session import cut_lineage


def device_window(df: DataFrame, schema: PanelSchema) -> Window:
    """Rows of a device in date order; remaining columns break duplicate-date ties."""
    ties = [c for c in (*METRIC_COLS, TARGET_COL) if c in df.columns]
    return Window.partitionBy("device").orderBy("date", *ties)


def device_features(df: DataFrame, schema: PanelSchema, levels=None) -> tuple[DataFrame, PanelSchema]:
    """two-character levels of the device id."""
    levels = levels or DEVICE_LEVELS
    cols = {name: F.substring("device", start, length) for name, (start, length) in levels.items()}
    return df.withColumns(cols), schema.with_(dev_cols=tuple(cols))


def date_parts(date: Column) -> dict:
    """Quarter, month, day, month-week, Monday-0 weekday, weekend flag."""
    d = F.dayofmonth(date)
    wd = F.weekday(date)
    return {"Q": F.quarter(date), "M": F.month(date), "D": d,
            "MW": month_week(d), "WD": wd, "WE": weekend(wd)}


def date_features(df: DataFrame, schema: PanelSchema) -> tuple[DataFrame, PanelSchema]:
    """Q, M, D, MW, WD, WE (int)."""
    parts = {k: v.cast("int") for k, v in date_parts(F.col("date")).items()}
    return df.withColumns(parts), schema.with_(date_cols=tuple(parts))


def full_zero_mark(df: DataFrame, schema: PanelSchema, mode: str = "sum",
                   cols=ZERO_DENSE_COLS) -> tuple[DataFrame, PanelSchema]:
    """f0 = 1 when the present zero-dense metrics sum to 0 (``mode='all'``: all are 0)."""
    zcols = present(df, cols)
    if mode == "sum":
        f0 = (row_sum(zcols) == 0).cast("int")
    else:
        f0 = row_max([F.abs(F.coalesce(F.col(c), F.lit(0))) for c in zcols]) == 0
        f0 = f0.cast("int")
    return df.withColumn("f0", f0), schema.with_(zdense_cols=tuple(zcols), f0_col="f0")


def strata(target: Column, f0: Column) -> Column:
    """2 for failures, 1 for non-failures with some non-zero metric, else 0."""
    return (F.when(target == 1, 2).when((target == 0) & (f0 == 0), 1).otherwise(0)).cast("int")


def add_strata(df: DataFrame, schema: PanelSchema) -> tuple[DataFrame, PanelSchema]:
    return (df.withColumn("strt", strata(F.col(schema.target_col), F.col(schema.f0_col))),
            schema.with_(strt_col="strt"))


def elapsed_days(df: DataFrame, schema: PanelSchema, fill: str = "device",
                 name: str = "elapsed") -> DataFrame:
    """W1 + W2: days since the device's previous row, back-filled.

    ``fill='device'``: a device's first row takes its second row's gap; one-row
    devices stay NULL.  ``fill='global'`` reproduces a back-fill over the whole
    (device, date)-sorted frame: a one-row device takes the first-row gap of
    the next device that has one (computed on a one-row-per-device table).
    """
    w = device_window(df, schema)
    gap = F.datediff(F.col("date"), F.lag("date").over(w))
    out = df.withColumn("__gap", gap).withColumn(
        name, F.coalesce(F.col("__gap"), F.lead("__gap").over(w)))
    if fill == "device":
        return out.drop("__gap")
    if fill != "global":
        raise ValueError(f"unknown fill {fill!r}")
    per_device = out.groupBy("device").agg(F.first(name, ignorenulls=True).alias("__own"))
    # Ranges of devices are filled each on their own; what is open at a range's end
    # takes the first gap of a later range (one row per range, a bounded table).
    ranges = cut_lineage(per_device.repartitionByRange("device").withColumn("__r", F.spark_partition_id()))
    # Read backwards: a frame that ends at the current row is kept as it grows, one that
    # starts there is gone through again for every row.
    nxt = Window.partitionBy("__r").orderBy(F.desc("device")).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.orderBy(F.desc("__r")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = (ranges.groupBy("__r").agg(F.min_by("__own", F.when(F.col("__own").isNotNull(), F.col("device"))).alias("__f"))
              .select("__r", F.last("__f", ignorenulls=True).over(later).alias("__after")))
    carried = (ranges.withColumn("__in", F.last("__own", ignorenulls=True).over(nxt)).join(F.broadcast(firsts), "__r")
               .withColumn("__next", F.coalesce("__in", "__after")))
    fill_tab = carried.where(F.col("__own").isNull()).select("device", "__next")
    return (out.join(fill_tab, "device", "left")
            .withColumn(name, F.coalesce(F.col(name), F.col("__next")))
            .drop("__gap", "__next"))


def change_metrics(df: DataFrame, schema: PanelSchema, keep_inf: bool = False,
                   drop=CHANGE_DROP, with_elapsed: bool = True,
                   fill: str = "device") -> tuple[DataFrame, PanelSchema]:
    """elapsed days plus ``ch*`` absolute percent change per metric.

    ``keep_inf=True`` keeps +inf where the previous value is 0 and the current
    one is not (the exploration report counts them); otherwise those are 0.
    """
    w = device_window(df, schema)
    nums = list(schema.num_cols)
    ffill = {f"__c_{m}": F.last(m, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
             for m in nums}
    out = df.withColumns(ffill)
    chg = {}
    for m in nums:
        cur = F.col(f"__c_{m}").cast("double")
        prev = F.lag(f"__c_{m}").over(w).cast("double")
        jump = F.lit(INF) if keep_inf else F.lit(0.0)
        chg[m.replace("m", "ch", 1)] = (
            F.when(prev.isNull() | cur.isNull(), F.lit(0.0))
            .when(prev == 0, F.when(cur == 0, F.lit(0.0)).otherwise(jump))
            .otherwise(F.abs(cur / prev - F.lit(1.0))))
    out = out.withColumns(chg).drop(*ffill)
    cols = list(chg)
    if with_elapsed:
        out = elapsed_days(out, schema, fill=fill)
        cols = ["elapsed"] + cols
    dropped = [c for c in (drop or ()) if c in out.columns and c in cols]
    out = out.drop(*dropped)
    return out, schema.with_(chng_cols=tuple(c for c in cols if c not in dropped))


def switch_metrics(df: DataFrame, schema: PanelSchema) -> tuple[DataFrame, PanelSchema]:
    """sw = on - previous on within the device (first row 0); on = m != 0 (NULL is on)."""
    w = device_window(df, schema)
    sw = {}
    for m in schema.num_cols:
        on = (~F.col(m).eqNullSafe(F.lit(0))).cast("int")
        sw[m.replace("m", "sw", 1)] = (on - F.coalesce(F.lag(on).over(w), on)).cast("int")
    return df.withColumns(sw), schema


def rank_metrics(df: DataFrame, schema: PanelSchema, drop=RANK_DROP) -> tuple[DataFrame, PanelSchema]:
    """sr* = standardised min-rank per metric, srav = row mean, srmx = row max."""
    nums = list(schema.num_cols)
    out = min_rank(df, nums)
    srs = [m.replace("m", "sr", 1) for m in nums]
    out = out.withColumns({"srav": row_mean(srs)})
    out = out.withColumn("srmx", row_max(srs + ["srav"]))
    cols = srs + ["srav", "srmx"]
    dropped = [c for c in (drop or ()) if c in cols]
    return out.drop(*dropped), schema.with_(rnk_cols=tuple(c for c in cols if c not in dropped))


def build_features(df: DataFrame, schema: PanelSchema) -> tuple[DataFrame, PanelSchema]:
    """F8: duplicate column -> device -> date -> change -> rank -> zero mark -> strata."""
    df, schema = drop_duplicate_columns(df, schema)
    df, schema = device_features(df, schema)
    df, schema = date_features(df, schema)
    df, schema = change_metrics(df, schema)
    df, schema = rank_metrics(df, schema)
    df, schema = full_zero_mark(df, schema)
    df, schema = add_strata(df, schema)
    return df, schema
