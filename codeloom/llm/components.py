"""Connected components of an edge table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); a component's name is its least node.

    Each round links every node to the least of its neighbourhood. Minima are summed up before each shuffle and stored
    before they are joined: both sides of the join then have an exchange of their own, so the rows of a node with very
    many neighbours are split over tasks (AQE's skew join). Rounds grow with the logarithm of the longest path, and go
    on until nothing changes. Loops (u = v) and null ends are no edges; repeated edges are one.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    count = now.count()
    while count:
        # large star: the larger neighbours of a node, and the node itself, go to the least of its neighbourhood
        ends = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        larger = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = stored(larger.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        # small star: the smaller neighbours of a node, and the node itself, go to the least of them
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        linked = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = stored(linked.where("u <> v").distinct(), "edges")
        n = after.count()
        settled = n == count and after.join(now, ["u", "v"], "left_anti").isEmpty()
        discard(least, large, low, now)
        now, count = after, n
        if settled:
            break
    named = now.groupBy("u").agg(F.min("v").alias("component"))
    return named.select(F.col("u").alias("node"), "component").unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
