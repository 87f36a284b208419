"""Connected components on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgeclock.shared import discard, materialise


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected links (a, b); a component is named by its smallest node.

    Every round a node takes the smallest name among its neighbours' and its own, and then the name that this name's node has
    taken, so names travel twice as far each round.  Rounds read written tables; a node with very many links is an
    ordinary skewed join key.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("next"))
    )
    both = materialise(both.distinct(), "links")
    named = materialise(both.select("node").distinct().withColumn("component", F.col("node")), "named")
    while True:
        told = both.join(named.select(F.col("node").alias("next"), "component"), "next").groupBy("node").agg(F.min("component").alias("least"))
        taken = named.join(told, "node").select("node", F.col("component").alias("old"), F.least("component", "least").alias("component"))
        taken = materialise(taken, "taken")
        ahead = taken.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = materialise(
            taken.join(ahead, "component").select("node", "old", F.least("component", "further").alias("component")), "named"
        )
        discard(named, taken)
        named = new.select("node", "component")
        named.stored_at = new.stored_at
        if new.where("component != old").isEmpty():
            discard(both)
            return named
