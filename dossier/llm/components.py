"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_empty, scratch


def _with_minimum(neighbours: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and all its neighbours. The minimum is combined map-side before the shuffle."""
    least = neighbours.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return neighbours.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = _with_minimum(down)
    return found.select(F.col("v").alias("u"), F.col("m").alias("v")).union(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph with edges (u, v).

    Returns (node, component): each node that has an edge to another node, with the least node of its component.
    Null ends and self-loops are ignored; an empty edge table gives an empty result.  Every round ends in a table in the
    shared folder, so lineage stays short and a lost executor costs one round at most.  The number of rounds grows with the
    logarithm of the number of nodes.
    """
    edges = scratch(edges.select(F.col(edges.columns[0]).alias("u"), F.col(edges.columns[1]).alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    if is_empty(edges):
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = _state(edges)
    for _ in range(most_rounds):
        edges = scratch(_small_star(_large_star(edges)), "stars")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("connected components did not converge")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
