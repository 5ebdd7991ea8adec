"""Mixing sources to target weights (3): hash-threshold histograms.

Every row has a 60-bit hash.  A source takes each of its rows as often as its
target holds the whole source, and, for what is left, the rows whose hash lies
below a threshold.  That threshold is found without sorting: sizes are summed by
source and the hash's first 12 bits, the bucket in which the budget ends is
found by prefix sums, and only this bucket's rows are summed by the next 12
bits, and so on down to one hash value.  Rows are then filtered by comparing.
Rows that are equal in id and text share their hash and are interchangeable: where
the budget ends among them, they are numbered, and as many are taken as bring the source
nearest to its target.

The histograms are keyed by (source, bucket), so a source with a third of all
rows is spread over 4096 keys, after partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"       # fixed value: what counts as a word of a size
BITS, LEVELS = 12, 5


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\x1f"), text)
    return docs.select(
        F.struct("*").alias("row"), F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("h"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources in the order of code points, null last, weigh ``weights``,
    repeating.  All share ``share`` of the total by weight; none gets over
    ``most`` times its size, and what this leaves is shared again by weight:
    the level at which caps and weights use up the total is found on the
    sources sorted by cap over weight.
    """
    everything, by_name = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("ratio", "place")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    x = (sizes.withColumn("place", F.row_number().over(by_name)).withColumn("w", w)
         .withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
         .withColumn("all", F.lit(float(share)) * F.sum("source_size").over(everything))
         .withColumn("full", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("heavy", F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("level", (F.col("all") - F.col("full")) / F.col("heavy"))
         .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)["level"]))
    return x.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def mixing_plan(rows: DataFrame, **how) -> DataFrame:
    """One row per source: size, target, whole copies, and the threshold of one more copy.

    ``rows (source, size, h)`` are read twice; the second time only where a
    source's budget ends.  ``cut`` is the last hash looked at, ``same`` the rows that
    have it, ``take`` how many of them are taken: the number that brings the source nearest to its target.
    """
    shift = (LEVELS - 1) * BITS
    first = cut_lineage(rows.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("m")))
    targets = source_targets(first.groupBy("source").agg(F.sum("n").alias("source_size")), **how)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = cut_lineage(targets.withColumn("copies", copies)
                          .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")))
    rest = targets.select("source", "rest").withColumn("base", F.lit(0).cast("long"))
    order = Window.partitionBy("source").orderBy("b")

    def end(hist: DataFrame, state: DataFrame) -> DataFrame:
        """Of each source the bucket in which its budget ends, and what lies before it."""
        return (hist.join(state, F.col("source").eqNullSafe(F.col("s2")))
                .select("source", "b", "n", "m", "rest", (F.col("base") + F.sum("n").over(order)).alias("upto"))
                .where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")) & (F.col("rest") > 0))
                .select("source", "b", "n", "m", "rest", (F.col("upto") - F.col("n")).alias("base")))

    def named(t: DataFrame) -> DataFrame:
        return t.select(F.col("source").alias("s2"), "rest", "base")

    at = cut_lineage(end(first, named(rest)))
    some = cut_lineage(rows.withColumn("b", F.shiftright("h", shift))
                       .join(at.select(F.col("source").alias("s2"), F.col("b").alias("b2")),
                             F.col("source").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")), "left_semi")
                       .groupBy("source", "h").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("m")))
    for level in range(1, LEVELS):
        shift -= BITS
        up = shift + BITS
        hist = (some.withColumn("p", F.shiftright("h", up))
                .join(at.select(F.col("source").alias("s2"), F.col("b").alias("p2")),
                      F.col("source").eqNullSafe(F.col("s2")) & (F.col("p") == F.col("p2")), "left_semi")
                .groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
        at = cut_lineage(end(hist, named(at)))
    nearest = F.ceil((F.col("rest") - F.col("base")) / (F.col("n") / F.col("m")) - 0.5)
    cuts = at.select(F.col("source").alias("s2"), F.col("b").alias("cut"), F.col("m").alias("same"),
                     F.greatest(F.lit(0), F.least(F.col("m"), nearest)).cast("long").alias("take"))
    return cut_lineage(targets.join(cuts, F.col("source").eqNullSafe(F.col("s2")), "left")
                       .select(F.col("source").alias("s2"), "source_size", "target", "copies", "cut", "same", "take"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                keep: list[str] | None = None, **how) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``, or of ``keep``), ``size``, ``source_size``, ``target``, ``taken``.

    ``taken`` is ``size`` times how often the mix takes the row.  Sizes are
    words; a null text has none, and rows of size 0 are never taken.  Null
    sources are one source, after all others.  Equal rows (id and text) have the
    same hash; where the budget ends among them, some are taken once more than others.  An empty table gives no
    rows.  Names in ``docs`` can't clash, as they stay inside ``row``.
    """
    rows = _prepared(docs if keep is None else docs.select(*dict.fromkeys([*keep, id_col, text_col, source_col])), id_col, text_col, source_col)
    if keep is not None:
        rows = cut_lineage(rows.withColumn("row", F.struct(*[F.col(f"row.`{c}`").alias(c) for c in keep])))
    narrow = rows.select("source", "size", "h")
    plan = mixing_plan(narrow if keep is not None else cut_lineage(narrow), **how)
    # The plan is a written table of one row per source, so Spark broadcasts it if its file is small enough.
    planned = rows.join(plan, F.col("source").eqNullSafe(F.col("s2")))
    out = ["row", "size", "source_size", "target"]
    at_cut = F.coalesce(F.col("h") == F.col("cut"), F.lit(False))

    def told(df: DataFrame, more) -> DataFrame:
        return df.select(*out, (F.col("size") * (F.col("copies") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0))).alias("taken"))

    if plan.where("take > 0 AND take < same").isEmpty():
        return told(planned, (F.col("h") < F.col("cut")) | (at_cut & (F.col("take") > 0)))
    # Only the rows of a cut are numbered: inside their partition, after the rows of earlier ones.
    cut = cut_lineage(planned.where(at_cut).withColumn("part", F.spark_partition_id()).withColumn("i", F.monotonically_increasing_id()))
    sizes = cut.groupBy("s2", "part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("s2").alias("s3"), F.col("part").alias("p3"), F.coalesce(F.sum("n").over(
        Window.partitionBy("s2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("s2", "part").orderBy("i"))
    numbered = cut.join(before, F.col("s2").eqNullSafe(F.col("s3")) & (F.col("part") == F.col("p3"))).withColumn("place", place)
    return told(planned.where(~at_cut), F.col("h") < F.col("cut")).unionByName(told(numbered, F.col("place") <= F.col("take")))


# The same on `documents` for DuckDB, with a sort instead of the histograms.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS place FROM s),
w AS (SELECT *, [3e0, 1e0, 2e0][((place - 1) % 3) + 1] AS w, 2e0 * source_size AS cap FROM p),
r AS (SELECT *, cap / w AS ratio, 1.5e0 * sum(source_size) OVER () AS everything FROM w),
l AS (SELECT *, (everything - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
             / sum(w) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size,
             least(cap, w * (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1)) AS target FROM l),
c AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
g AS (SELECT source, h, sum(size) AS n, count(*) AS m, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
e AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS place FROM d)
SELECT e.doc_id, e.size, c.source_size, c.target,
       CAST(e.size * (c.copies + CASE WHEN g.n > 0 AND
         e.place <= ceil((c.target - c.copies * c.source_size - (g.upto - g.n)) / (g.n / g.m) - 0.5) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e JOIN c ON e.source IS NOT DISTINCT FROM c.source
JOIN g ON e.source IS NOT DISTINCT FROM g.source AND e.h = g.h
"""
