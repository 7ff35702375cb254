"""Connected components of a large graph by alternating large-star and small-star steps, without gathering any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _to_least(edges: DataFrame, label: str) -> DataFrame:
    """For edges (u, v): the least v of each u, below u itself. Saved, so that the join on hubs can be split."""
    return saved(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least")), label)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u long, v long): root is the least node that it is connected to.

    Rows may repeat and point either way; loops are ignored. Isolated nodes are not listed. The steps end when the
    edge set no longer changes, after O(log^2 n) of them.
    """
    e = saved(edges.where("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct(), "cc-start")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.selectExpr("v as u", "u as v"))
        large = both.join(_to_least(both, "cc-large"), "u").where("v > u and v <> least").selectExpr("v as u", "least as v")
        # a node whose least neighbour lies above it keeps nothing here; its neighbours point at it
        large = saved(large.distinct(), "cc-large-edges")
        small = large.join(_to_least(large, "cc-small"), "u")
        small = small.where("v <> least").selectExpr("v as u", "least as v").unionByName(small.selectExpr("u", "least as v"))
        e = saved(small.where("u <> v").distinct(), "cc-edges")
        after = _state(e)
        if after == before:
            break
        before = after
    nodes = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return nodes.unionByName(e.selectExpr("v as node", "v as root").distinct())
