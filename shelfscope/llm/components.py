"""Connected components of a stored edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, keep: Scratch) -> DataFrame:
    """id, component (the smallest id reachable) of every id that has an edge to another id.

    `edges` has two integer columns. Each round hands every node's larger, then all its
    neighbours to the smallest one; the table shrinks to one star per component. The
    minimum of a node is a map-side aggregate, and the join on it is one of two stored
    tables, so that adaptive execution can split a node with very many neighbours.
    Edges with a null end and loops are left out. No edges give no rows.
    """
    a, b = edges.columns
    linked = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    star = keep.stored(edges.where(linked).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(star)
    while state[0]:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = keep.stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        large = keep.stored(
            both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        smallest = keep.stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(smallest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = keep.stored(small.union(smallest.select("u", F.col("m").alias("v"))).distinct())
        if (now := _state(star)) == state:
            break
        state = now
    return star.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        star.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
