"""Skew-safe value lookups (equi-join of a big table to a per-value table).

Values whose row frequency is at least 1 / ``hot_parts`` of all rows are
"hot": there can be at most ``hot_parts`` of them, so that part of the table
has a proven size bound and is broadcast.  Rows carrying a hot value get a
salted key that cannot match the cold part, so the cold join (which the
planner broadcasts only when its file-backed size is small) never puts a
value holding a third of all rows into one shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_PARTS = 20_000          # values with > N / HOT_PARTS rows are hot


def skew_safe_lookup(df: DataFrame, col: str, table: DataFrame, key: str, out_cols: list[str],
                     count_col: str, total_col: str, salt_from: list[str],
                     hot_parts: int = HOT_PARTS, salts: int = 1024) -> DataFrame:
    """Lazy left lookup with no driver-side size check and no skewed partition.

    Values holding at least ``1/hot_parts`` of all rows (``count_col * hot_parts
    >= total_col``) are at most ``hot_parts`` rows: that part is broadcast.  The
    remaining (cold) values each hold fewer rows; rows whose value is hot get a
    salted, non-matching key for the cold join, so they spread over ``salts``
    hash buckets instead of landing in one partition.  The cold join itself is
    planned by Spark (AQE broadcasts it at run time when it is small).
    """
    t = table.select(F.col(key).alias("__k"), *out_cols, F.col(count_col).alias("__cnt"),
                     F.col(total_col).alias("__tot"))
    is_hot = F.col("__cnt") * F.lit(hot_parts) >= F.col("__tot")
    hot = t.where(is_hot).select("__k", *[F.col(c).alias(f"__h_{c}") for c in out_cols])
    cold = t.where(~is_hot).select(F.struct(F.col("__k").alias("v"), F.lit(0).alias("s")).alias("__ck"),
                                   *[F.col(c).alias(f"__c_{c}") for c in out_cols])
    x = df.join(F.broadcast(hot), F.col(col) == F.col("__k"), "left").drop("__k")
    hot_hit = F.col(f"__h_{out_cols[0]}").isNotNull()
    salt = (F.pmod(F.xxhash64(*salt_from), F.lit(salts)) + 1).cast("int")
    x = x.withColumn("__ck", F.struct(F.col(col).alias("v"), F.when(hot_hit | F.col(col).isNull(), salt).otherwise(F.lit(0)).alias("s")))
    x = x.join(cold, "__ck", "left").drop("__ck")
    return x.select(*[c for c in df.columns],
                    *[F.coalesce(F.col(f"__h_{c}"), F.col(f"__c_{c}")).alias(c) for c in out_cols])


def skew_safe_metric_lookup(long: DataFrame, table: DataFrame, out_cols: list[str], salt_from: str,
                            hot_parts: int = HOT_PARTS, salts: int = 1024) -> DataFrame:
    """``skew_safe_lookup`` for all metrics at once: ``long (.., metric, v)`` meets
    ``table (metric, v, cnt, n, out_cols..)`` in one hot and one cold join.

    Of each metric at most ``hot_parts`` values are hot; rows that carry one, or
    a NULL, get a salted key that matches no cold value.
    """
    hot = table.where(F.col("cnt") * hot_parts >= F.col("n")).select("metric", "v", *[F.col(c).alias(f"__h_{c}") for c in out_cols])
    cold = table.where(F.col("cnt") * hot_parts < F.col("n")).select(
        "metric", "v", F.lit(0).alias("__s"), *[F.col(c).alias(f"__c_{c}") for c in out_cols])
    x = long.join(F.broadcast(hot), ["metric", "v"], "left")
    salt = (F.pmod(F.xxhash64(salt_from), F.lit(salts)) + 1).cast("int")
    off = F.col(f"__h_{out_cols[0]}").isNotNull() | F.col("v").isNull()
    x = x.withColumn("__s", F.when(off, salt).otherwise(F.lit(0))).join(cold, ["metric", "v", "__s"], "left")
    return x.select(*long.columns, *[F.coalesce(F.col(f"__h_{c}"), F.col(f"__c_{c}")).alias(c) for c in out_cols])
