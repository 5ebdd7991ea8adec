"""Result-table sources and sinks.

Search and ablation results are small report tables saved as header CSV with
the pandas index as first column; the sink names each run by a timestamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_result_csv(spark: SparkSession, path: str, schema=None,
                    drop_index: bool = True) -> DataFrame:
    """Header CSV; the first (saved index) column is dropped."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    return df.drop(df.columns[0]) if drop_index else df


def run_stamp(spark: SparkSession) -> str:
    """``yyyyMMdd_HHmm`` of the current time, as used in result file names."""
    return spark.range(1).select(
        F.date_format(F.current_timestamp(), "yyyyMMdd_HHmm")).first()[0]


def write_result_csv(df: DataFrame, base_dir: str, name: str, stamp: str | None = None,
                     best_id=None) -> str:
    """Write ``df`` under ``{base_dir}/{name}_{stamp}[_{best_id}]``; never overwrites."""
    stamp = stamp or run_stamp(df.sparkSession)
    suffix = f"_{best_id}" if best_id is not None else ""
    path = f"{base_dir.rstrip('/')}/{name}_{stamp}{suffix}"
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path
