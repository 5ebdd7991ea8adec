"""Connected components of a link table, as joins that shrink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; a root is one node of its component.

    In each round every node looks for the least of itself and its neighbours
    (in the order of a hash, so that paths are short), follows it twice, and the
    links are rewritten between what is left of the components.  A round
    removes all nodes but local minima, so links are used up in about
    log(longest path) rounds; a hub of any degree is one partially aggregated
    minimum.  Each round is written to the shared checkpoint folder.  Links
    with a null end or between a node and itself are ignored.
    """
    both = links.where("a <> b").select("a", "b")
    edges = cut_lineage(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = None
    while names is None or not edges.isEmpty():
        rank = F.struct(F.xxhash64("b").alias("o"), F.col("b").alias("v"))
        least = edges.groupBy("a").agg(F.min(rank).alias("m")).select(
            F.col("a").alias("node"),
            F.least("m", F.struct(F.xxhash64("a").alias("o"), F.col("a").alias("v")))["v"].alias("up"))
        step = cut_lineage(least.join(least.select(F.col("node").alias("up"), F.col("up").alias("root")), "up").select("node", "root"))
        names = step if names is None else _followed(names, step)
        to_a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        to_b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = cut_lineage(edges.join(to_a, "a").join(to_b, "b").where("ra <> rb")
                            .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    return cut_lineage(names)


def _followed(names: DataFrame, step: DataFrame) -> DataFrame:
    """``names`` with its roots replaced by theirs in ``step``."""
    return (names.join(step.select(F.col("node").alias("root"), F.col("root").alias("r2")), "root", "left")
            .select("node", F.coalesce("r2", "root").alias("root")))


def extended(names: DataFrame | None, links: DataFrame) -> DataFrame:
    """``components`` of all links so far, given those of the earlier ones: only links between them are followed."""
    if names is None:
        return components(links)
    of_a, of_b = (names.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    mapped = (links.join(of_a, "a", "left").join(of_b, "b", "left")
              .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    more = components(mapped)
    fresh = more.select("node", F.col("node").alias("root")).join(names.select("node"), "node", "left_anti")
    return cut_lineage(_followed(names.union(fresh), more))
