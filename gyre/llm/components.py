"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyre.llm.exchange import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest node reachable over `edges`, for every node of an edge.

    Large-star and small-star rounds until nothing changes: each node's neighbours are joined to
    the smallest of them. A round is grouped minima and joins on the node, so a node with very many
    neighbours is combined before the shuffle and its join can be split. Rounds grow with
    the logarithm of a component's size. Nulls and loops are ignored.
    """
    def stored(df: DataFrame) -> DataFrame:
        return written(df.distinct())

    def lowest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    pairs = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v")
    )
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        root = lowest(both).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = stored(pairs.join(root, "v").select("u", F.col("m").alias("v")))
        low = lowest(large)
        pairs = stored(
            large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
            .union(low.select("u", F.col("m").alias("v")))
        )
        parents = pairs.select(F.col("v").alias("u")).distinct()
        open_ = pairs.join(parents, "u", "left_semi").select("u").limit(1).union(
            pairs.groupBy("u").count().where("count > 1").select("u").limit(1)
        )
        if not open_.take(1):
            break
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
