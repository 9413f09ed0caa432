"""Connected components of a graph that is a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidegrid.llm.common import checkpointed


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())


def _stars(edges: DataFrame, both: bool) -> DataFrame:
    """Link what is next to each node to the least of its neighbours.

    both: over all neighbours, for those larger than the node; else over the smaller ones, the node too.
    """
    near = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = near.join(least, "a")
    if both:
        linked = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = linked.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return linked.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that can be reached, for every node that has a link.

    links has columns a and b; links of a node to itself count for nothing and repeats are harmless.
    Large-star and small-star steps alternate until the links no longer change; then each node
    is linked to its component's smallest node. Each round is checkpointed.
    """
    edges = checkpointed(
        links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before, now = None, _mark(edges)
    while now[0] and before != now:
        before, edges = now, checkpointed(_stars(_stars(edges, True), False))
        now = _mark(edges)
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").union(
        edges.select("b", F.col("b").alias("c")).distinct()
    )
