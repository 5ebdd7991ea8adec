"""From ``documents`` to packed training sequences, in four stages.

Each stage takes all rows that the one before kept, is written as Parquet, and
is read again as the next one's documents; all but the last keep the columns of
``documents``.  Stages hold on nulls, empty texts, repeated rows, empty tables
and further columns as their operators do (see ``faultline.llm``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.mixing import mix_sources
from faultline.llm.near_dedup import near_duplicates
from faultline.llm.packing import pack_concat
from faultline.llm.toxicity import fit_toxicity, score_toxicity
from faultline.session import cut_lineage
from faultline.sources.panel import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic (5), by a model of their labels in ``labels``.

    Without labels of both classes nothing is rejected but by the share of toxic labels.
    """
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    inner = [f"d{i}" for i in range(len(docs.columns))]           # a column may be called like one that is added
    named = docs.toDF(*inner)
    scored = score_toxicity(named, model, inner[docs.columns.index("doc_id")], inner[docs.columns.index("text")], keep=inner)
    return scored.where("predicted = 0").select(*[F.col(n).alias(c) for n, c in zip(inner, docs.columns, strict=True)])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least id, of each class of near-duplicates (1).

    Rows are numbered, so what goes is a row, not an id: of rows that repeat, ids
    and nulls included, one stays, and a text stays whatever other texts of its id do.
    Rows with an id come before those without.
    """
    inner = [f"d{i}" for i in range(len(docs.columns))]
    at, text = inner[docs.columns.index("doc_id")], inner[docs.columns.index("text")]
    rows = cut_lineage(docs.toDF(*inner).withColumn("row", F.monotonically_increasing_id()))
    classes = cut_lineage(near_duplicates(rows, "row", text).select("row", "class_id"))
    first = F.struct(F.col(at).isNull(), F.col(at), F.col("row"))
    stay = classes.join(rows.select("row", at), "row").groupBy("class_id").agg(F.min(first)["row"].alias("row"))
    # The rows that go are the smaller part; written, Spark knows their size and broadcasts them only if it is small.
    gone = cut_lineage(classes.select("row").join(stay.select("row"), "row", "left_anti"))
    return rows.join(gone, "row", "left_anti").select(*[F.col(n).alias(c) for n, c in zip(inner, docs.columns, strict=True)])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them (3): zero, one or two times.

    Documents without a word add nothing to a budget and are not taken.
    """
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0)).cast("int")
    taken = mix_sources(docs).withColumn("times", times).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences with their ids (6)."""
    return pack_concat(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                    "sequence_id", "offset", "ids")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]
ORACLE_SQL = None                 # a trained model decides in the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
