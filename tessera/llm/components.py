"""Connected components of a graph of long ids, by alternating star operations.

Edges point from a node to a smaller one. A large star links every larger neighbour of a node to the
smallest node around it, a small star does so for the smaller neighbours; both keep components, and
repeating them ends in one star around the smallest node of each. A step is one aggregation and one
join; a hub's edges are a skewed side of a join of two plain exchanges, which adaptive execution
splits. Every step is written to the shared folder, so that lost executors cost one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool, made: list[DataFrame]) -> DataFrame:
    """edges: (u, v); returns (u, v) with u > v, distinct. ``made`` gets the tables that it reads."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = common.materialised(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    made.append(least)
    out = around.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
    return out.where("u > v").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(u, v): for each node that isn't the smallest of its component, that smallest node."""
    read = getattr(edges, "_tessera_reads", ())
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = common.materialised(common.reads(edges, *read), "edges")
    before = _sum(edges)
    for _ in range(most):
        if not before[0]:
            return edges
        made = [edges]
        edges = _star(_star(edges, True, made), False, made)
        edges = common.materialised(common.reads(edges, *made), "edges")
        now = _sum(edges)
        if now == before:
            return edges
        before = now
    raise RuntimeError("components didn't settle")
