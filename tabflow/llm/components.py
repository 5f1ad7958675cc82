"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.session import cut_lineage


def connected(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """``node`` and ``root``, the smallest node that links lead to, for every node of ``links``.

    Every round hangs each node's larger neighbours, then each node and its smaller neighbours, on the smallest one
    near it, until all links point at a root. A round joins links with one row per node, so a node with very
    many links is a hot key of a join that can be split, never a group of one task. Links with a null end are left out.
    """
    links = cut_lineage(links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).dropna().filter("low < high").distinct())
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("high").alias("low"), F.col("low").alias("high")))
        nearest = cut_lineage(both.groupBy("low").agg(F.min("high").alias("least")).select("low", F.least("low", "least").alias("least")))
        # Larger neighbours hang on the smallest node around.
        large = both.filter("high > low").join(nearest, "low").select(F.col("least").alias("low"), "high").filter("low < high").distinct()
        large = cut_lineage(large)
        # So do the node itself and its smaller neighbours.
        least = cut_lineage(large.groupBy("high").agg(F.min("low").alias("least")))
        hung = large.join(least, "high").filter("low > least").select(F.col("least").alias("low"), F.col("low").alias("high"))
        new = cut_lineage(hung.unionByName(least.select(F.col("least").alias("low"), "high")).distinct())
        # Done when no node is both above and below another.
        if new.join(new.select(F.col("low").alias("high")).distinct(), "high", "left_semi").isEmpty() and new.groupBy("high").count().filter("count > 1").isEmpty():
            links = new
            break
        links = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(links.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
