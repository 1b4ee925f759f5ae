"""Connected components by alternating large and small stars, in joins and pre-aggregated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lmprep.llm.store import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its least neighbour (or itself) to its larger neighbours, or to its smaller ones and itself."""
    turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = edges.union(turned) if large else edges.union(turned).where("v < u")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    passed = around.where("v > u") if large else around
    out = passed.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge up at most, and none that has one is led to; ``u > v`` in every edge."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("led")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("led").alias("led"))
    return nodes.where(F.col("up") + F.col("led") > 1).agg(F.count("*")).first()[0] == 0


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; ``root`` is the least node that links reach.

    Nodes are longs. Links may repeat, be reversed or lead to themselves (those name no node). Each round halves the depth of
    the trees at least, so rounds grow with the logarithm of the longest path.
    """
    ends = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = written(links.select(*ends).where("u <> v").distinct(), "edges")
    while not _is_forest_of_stars(edges):
        edges = written(_stars(_stars(edges, large=True), large=False), "edges")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def more_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) as ``connected_components`` gives for the links behind ``roots`` and ``links`` (a, b) together.

    Only links between different components take part, as links of their roots.
    """
    ends = links.select("a", "b")
    for end in ("a", "b"):
        known = roots.select(F.col("node").alias(end), F.col("root").alias("top"))
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
    tops = written(connected_components(ends), "tops")
    risen = roots.join(tops.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    risen = risen.select("node", F.coalesce("top", "root").alias("root"))
    return written(risen.union(tops.join(roots, "node", "left_anti").select("node", "root")), "roots")
