"""Connected components of a distributed edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterglass.llm.common import anew, cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )


def _star(pairs: DataFrame) -> DataFrame:
    """Every (u, v) as an edge from v to the least of u and all its v, and u to that least as well."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = pairs.join(anew(least, "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.union(own).filter("a != b").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (a, b); root is the least node of its component.

    A round links each node's larger neighbours to its least one, then its smaller ones; the
    minimum of a node is aggregated before the shuffle and the join back to a node with very many
    neighbours can be split, so a star of any size is no one task's work. The edges go through the
    shared checkpoint folder each round. It stops when a round changes nothing.
    """
    edges = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
    )
    mark = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark or now[0] == 0:
            break
        mark = now
        # Larger neighbours go to the least neighbour; pairs that point down stay as they are.
        large = _star_large(edges)
        edges = cut_lineage(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def _star_large(edges: DataFrame) -> DataFrame:
    pairs = _both_ways(edges)
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = pairs.filter("v > u").join(anew(least, "u"), "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return up.filter("a != b").distinct()
