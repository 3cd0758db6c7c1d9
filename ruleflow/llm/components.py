"""Connected components of a link table by alternating star operations, all of it in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruleflow.storage import Scratch


def connected_components(links: DataFrame, scratch: Scratch, name: str = "links") -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node of the component.

    Each round points every node's larger neighbours, then its smaller ones, at the smallest neighbour.
    That keeps the components, and ends with stars around the smallest nodes after a number of rounds
    that grows with the logarithm of the links. A hub's neighbours are never gathered: minima are
    pre-aggregated, and they go back to the links by a join, whose hot keys adaptive execution splits.
    Every round is a stored table, so a lost executor costs one round at most. Self-links and NULLs add
    nothing; a node that has no other link is not in the result.
    """
    current = scratch.store(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        f"{name}-0",
    )
    before = fingerprint(current)
    for number in range(1, 100):
        current = scratch.store(small_star(large_star(current)), f"{name}-{number}")
        now = fingerprint(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return nodes.unionByName(roots)


def fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node, linked to the node's smallest neighbour or the node itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    larger = both.filter("b > a").join(lowest, "a")
    return larger.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, linked to the smallest one."""
    lowest = links.groupBy("a").agg(F.min("b").alias("low"))
    smaller = links.join(lowest, "a").filter("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return smaller.unionByName(lowest.select("a", F.col("low").alias("b"))).distinct()
