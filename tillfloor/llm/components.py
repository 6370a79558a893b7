"""Connected components by contraction, in joins and grouped minima only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillfloor.llm.common import stage


def components(links: DataFrame, keep: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """(node, component) of links (a, b): the smallest node that each node can reach.

    In each pass every node moves to its smallest neighbour and on to where that one moves,
    and links are renamed. Moves only go down, so the smallest node stays put and names the rest.
    Passes end when no link is left; chains shrink geometrically, stars in one pass. Each pass is
    written by `keep`, which cuts the lineage. Links to oneself and nulls are ignored.
    """
    edges = _both_ways(links.filter(F.col("a") != F.col("b")))
    moved: list[DataFrame] = []
    while not edges.isEmpty():
        down = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to"))
        ahead = down.select(F.col("node").alias("to"), F.col("to").alias("then"))
        step = keep(down.join(ahead, "to", "left").select("node", F.coalesce("then", "to").alias("to")))
        moved.append(step)
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        renamed = edges.join(left, "a").select("b", "x").distinct().join(right, "b").select("x", "y")
        edges = keep(_both_ways(renamed.filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct())
    if not moved:
        node = links.select(F.col("a").alias("node"), F.col("a").alias("component"))
        return node.limit(0)
    out = moved[0].select("node", F.col("to").alias("component"))
    for step in moved[1:]:
        onward = step.select(F.col("node").alias("component"), "to")
        out = out.join(onward, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return out


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
