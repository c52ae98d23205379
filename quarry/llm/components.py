"""Connected components of a graph too large for the driver.

Large-star and small-star steps (Kiveris et al., 2014) turn the edges into stars around each
component's smallest node. A step is a minimum per node, joined back to the edges; the edges
are written after each round, so neither lineage nor a lost executor costs earlier rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written


def _linked_to_least(sided: DataFrame) -> DataFrame:
    """sided (u, v): every neighbour of u, and u, tied to the least of them."""
    # written, so that the edges of a hub can be split over tasks against its one row
    least = written(sided.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return sided.join(least, "u")


def components(edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """(node, component) of every node of the edges (u, v); component is its smallest node.

    Repeated edges, loops and both directions are allowed. No edges give no rows.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    said = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _linked_to_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        down = _linked_to_least(large)
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct(), name)
        tells = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tells == said:
            break
        said = tells
    else:
        raise RuntimeError("components did not settle")
    heads = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads)
