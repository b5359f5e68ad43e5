"""Connected components of an edge table, by alternating large and small stars.

Every round is a few aggregates and equi-joins over the edges, whose number never
grows; nodes of very many edges are broadcast, so their edges stay where they are. Rounds are written
to the shared folder, so lineage stays short, and the one before is deleted. They end when
all edges are stars. Only one number a round reaches the driver. The rounds needed grow
with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, joined_by_key, stored


def settled(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are stars: each node has one edge to a centre, or is one."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    odd = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or (out = 1 and in = 1)")
    return odd.agg(F.count("*")).head()[0] == 0


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of edges (u, v): component is the smallest id reachable."""
    now = stored(edges.where("u is not null and v is not null").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u <> v").distinct(), "stars")
    for _ in range(most_rounds):
        if settled(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"), "n")
        large = joined_by_key(both, least, {"c": "u"}, "n", 2 * now.count()).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        linked = large.join(least, large["u"] == least["c"])  # of a node, edges to smaller ones: few after the large star
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(linked.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, stored(small, "stars")
        forget(before)
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
