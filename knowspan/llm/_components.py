"""Connected components of an edge table, by Spark joins alone.

Alternates the two star steps of Kiveris et al. (2014): the large star hangs every larger neighbour of a
node on the node's smallest neighbour, the small star every smaller one. Both are a minimum by node
(combined before the shuffle) and a join, so a node with a million neighbours is no single group. The
edges end as stars around the smallest member of each component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knowspan.llm._scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """id, component of each node of ``edges`` (a, b) but those that are a component's smallest member.

    Goes on until a round leaves the table of edges as it was; rounds grow with the logarithm of the nodes."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, rows, held, k = scratch.table(f"{name}-0", pairs), -1, f"{name}-0", 0
    while True:
        k += 1
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        table = scratch.table(f"{name}-{k}", small)
        now = table.count()
        same = now == rows and table.join(pairs, ["u", "v"], "left_anti").isEmpty()
        scratch.drop(held)
        pairs, rows, held = table, now, f"{name}-{k}"
        if same:
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
