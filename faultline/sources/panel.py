"""Panel sources (S1, S2) and the panel view over the driver's test tables.

The study reads one Latin-1 CSV of daily device metrics, drops whole-row
duplicates, renames ``attributeN`` to ``mN`` and fixes the column order.  On the
test data there is no device table, so ``panel_from_events`` derives one from
``events`` with a single aggregate (partial aggregation on the map side, one
shuffle on ``(user_id, day)``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import nan_to_null
from faultline.schema import KEY_COLS, METRIC_COLS, RAW_CSV_SCHEMA, TARGET_COL, PanelSchema


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_panel_csv(spark: SparkSession, path: str, date_format: str = "yyyy-MM-dd", infer: bool = False) -> DataFrame:
    """Header CSV, Latin-1, the study's types.

    The file's column order is not fixed, so only the header line is read
    first; the declared types are then laid out in that order.  Metrics are whole numbers,
    and a decimal stops the load; with ``infer`` one pass over the metrics finds those
    that have decimals, which are doubles then.
    """
    from pyspark.sql import types as T
    options = {"header": True, "encoding": "ISO-8859-1", "dateFormat": date_format, "mode": "FAILFAST"}
    header = spark.read.options(**options).option("inferSchema", False).csv(path).columns
    declared = {f.name: f for f in RAW_CSV_SCHEMA.fields}
    if infer:
        metrics = [c for c in header if c.startswith("attribute")]
        text = T.StructType([T.StructField(c, T.StringType()) for c in header])
        whole = r"\s*[+-]?\d+\s*"
        found = spark.read.options(**options).schema(text).csv(path).agg(
            *[F.max((~F.col(f"`{c}`").rlike(f"^{whole}$")).cast("int")).alias(c) for c in metrics]).first()
        declared |= {c: T.StructField(c, T.DoubleType()) for c in metrics if found[c] == 1}
    schema = T.StructType([declared.get(c, T.StructField(c, T.StringType())) for c in header])
    return spark.read.options(**options).schema(schema).csv(path)


def tidy_panel(raw: DataFrame) -> tuple[DataFrame, PanelSchema]:
    """S2 minus the scan: whole-row dedup, ``attribute``->``m`` rename, reorder, NaN metrics to NULL."""
    renamed = raw.withColumnsRenamed(
        {c: c.replace("attribute", "m") for c in raw.columns if c != TARGET_COL})
    cols = list(KEY_COLS) + list(METRIC_COLS) + [TARGET_COL]
    floats = {f.name for f in renamed.schema.fields if f.dataType.typeName() in ("double", "float")} & set(METRIC_COLS)
    return dedup_by_device(renamed.select(*[nan_to_null(c).alias(c) if c in floats else c for c in cols])), PanelSchema()


def dedup_by_device(df: DataFrame) -> DataFrame:
    """P5: whole-row dedup on a device hash partitioning.

    Hash partitioning on ``device`` satisfies the dedup's clustering on all
    columns and every later per-device window, so the panel is shuffled once.
    A device holds at most one row per day, so no partition is skewed.
    """
    return df.repartition("device").dropDuplicates()


def load_panel(spark: SparkSession, path: str) -> tuple[DataFrame, PanelSchema]:
    """``(panel, schema)`` from a device-metrics CSV (or a parquet folder)."""
    if path.endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raw = read_panel_csv(spark, path)
    return tidy_panel(raw)


def panel_from_events(events: DataFrame) -> DataFrame:
    """Device-day panel derived from the ``events`` table.

    All metrics are integer cents or counts so sums are exact in any order.
    """
    c = F.col("c")
    et = F.col("event_type")
    uid = F.col("user_id")

    def count_of(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    click_big = F.sum(F.when((et == "click") & (c > 5000), c).otherwise(0)).cast("bigint")
    e = events.select(
        "user_id", "event_type",
        F.col("ts").cast("date").alias("date"),
        F.round(F.col("value") * 100).cast("bigint").alias("c"))
    agg = e.groupBy("user_id", "date").agg(
        F.sum(c).cast("bigint").alias("m1"),
        count_of(et == "signup").alias("m2"),
        count_of(et == "purchase").alias("m3"),
        count_of((et == "view") & (c > 5000)).alias("m4"),
        F.count(F.lit(1)).cast("bigint").alias("m5"),
        F.max(c).cast("bigint").alias("m6"),
        click_big.alias("m7"),
        click_big.alias("m8"),
        count_of((et == "view") & (c <= 2000)).alias("m9"),
        F.when(F.sum(F.when(et == "error", 1).otherwise(0)) >= 3, 1).otherwise(0).alias(TARGET_COL),
    )
    device = F.concat(F.lit("S"), (uid % 3).cast("string"), F.lit("F"),
                      (uid % 4).cast("string"),
                      F.when(F.length(uid.cast("string")) >= 4, uid.cast("string"))
                      .otherwise(F.lpad(uid.cast("string"), 4, "0")))       # padded, never cut
    return agg.select(device.alias("device"), "date", *METRIC_COLS, TARGET_COL)


def testdata_panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PanelSchema]:
    """Panel view over ``{sf_dir}/events.parquet`` with its starting schema."""
    return panel_from_events(read_table(spark, sf_dir, "events")), PanelSchema()
