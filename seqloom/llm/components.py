"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from seqloom.llm.common import materialise


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """``edges`` (a long, b long) to (node, label): the smallest node that each node can reach.

    Only nodes with an edge to another node appear. Each step joins nodes to the smallest neighbour
    (a partial aggregation) and is written to the shared folder. Steps end when nothing moves.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    current = materialise(both.distinct(), "edges")
    if current.isEmpty():
        return current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    for _ in range(limit):
        seen = Observation()
        # large star: all larger neighbours of u go to the smallest of u and its neighbours
        around = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") != F.col("u")).cast("long").alias("moved"))
        large = large.groupBy("u", "v").agg(F.max("moved").alias("moved"))
        # small star: u and its smaller neighbours go to the smallest of them
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select("u", "v", "m", "moved")
        # a row for the edge that goes on, and one for the smaller neighbour if it isn't the smallest
        small = small.observe(seen, F.sum("moved").alias("moved"), F.sum((F.col("v") != F.col("m")).cast("long")).alias("met"))
        ends = F.when(F.col("v") == F.col("m"), F.array(F.struct("u", F.col("m").alias("v")))).otherwise(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        current = materialise(small.select(F.explode(ends).alias("e")).select("e.u", "e.v").distinct(), "edges")
        # in a forest of stars nothing moves
        if not any(seen.get.values()):
            return current.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
    raise RuntimeError(f"no fixed point after {limit} steps")
