"""Connected components of link tables, by hooking and contraction on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """Columns node and component (the smallest node reachable) for every node of the links a, b (any orderable type).

    In each round every node points to its smallest neighbour, and pointers of pointers are followed once. Links are then
    drawn between what they point to. Each round at least halves what is left, so rounds grow with the logarithm of the
    longest way. A node with many links is only ever grouped by a minimum. Nulls and self-links don't count.
    """
    found = None
    edges = links.select("a", "b").where("a <> b")
    edges = stored(edges.union(edges.select("b", "a")).distinct())
    while True:
        point = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"))
        over = point.select(F.col("a").alias("p"), F.col("p").alias("q"))
        point = stored(point.join(over, "p").select("a", F.col("q").alias("p")))
        if found is None:
            found = point.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            moved = point.select(F.col("a").alias("component"), F.col("p").alias("next"))
            found = stored(found.join(moved, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
        of_b = point.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = stored(edges.join(point, "a").join(of_b, "b").where("p <> pb").select(F.col("p").alias("a"), F.col("pb").alias("b")).distinct())
        if edges.isEmpty():
            return found
