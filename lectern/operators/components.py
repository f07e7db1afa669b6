"""Connected components of a graph that no single machine has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.plans.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """id, root for every vertex of ``edges`` (a, b: long): root is the least id of its component.

    Each round maps every vertex to the least of itself and its neighbours and contracts the graph along that map, which at
    least halves the vertices of every component that still has edges; the maps are then composed. A vertex with very many
    neighbours is aggregated before the shuffle. Loops and repeated edges do no harm; vertices with loops only are left out.
    """
    left = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(ends.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "contraction")
        maps.append(step)
        moved = left.join(step.hint("merge"), "a").select("b", F.col("to").alias("_a"))
        moved = moved.join(step.withColumnRenamed("a", "b").hint("merge"), "b").select(F.col("_a").alias("a"), F.col("to").alias("b"))
        left = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    if not maps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    found = maps[0].select(F.col("a").alias("id"), F.col("to").alias("root"))
    for step in maps[1:]:
        found = found.join(step.withColumnRenamed("a", "root").hint("merge"), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return materialize(found, "components")
