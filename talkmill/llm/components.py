"""Connected components of a link table, without collecting links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkmill.session import cut


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``root`` for every node of ``links``; nodes of a component share a root.

    Each round moves every node to the neighbour (or itself) of least hashed priority and
    contracts the links accordingly, so the links shrink by a constant factor a round even
    along a chain.  Every round is a map-side aggregate and two joins; tables of a round are
    checkpointed, so a lost executor costs one round.  Only "are there links left" reaches
    the driver.
    """
    one, two = links.select(F.col(left).alias("u"), F.col(right).alias("v")), None
    two = one.select(F.col("v").alias("u"), F.col("u").alias("v"))
    edges = cut(one.unionByName(two).where(F.col("u") != F.col("v")).distinct())
    nodes = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    while not edges.isEmpty():
        nearest = edges.groupBy("u").agg(F.min(_priority("v")).alias("best"))
        step = cut(nearest.select(
            "u", F.least(_priority("u"), F.col("best")).alias("best"))
            .select("u", F.col("best.n").alias("to")))
        nodes = cut(nodes.join(step, F.col("root") == F.col("u"), "left")
                    .select("node", F.coalesce("to", "root").alias("root")))
        ahead = step.select(F.col("u").alias("v"), F.col("to").alias("to_v"))
        edges = cut(edges.join(step, "u").join(ahead, "v")
                    .select(F.col("to").alias("u"), F.col("to_v").alias("v"))
                    .where(F.col("u") != F.col("v")).distinct())
    return nodes


def _priority(node: str) -> Column:
    return F.struct(F.xxhash64(node).alias("p"), F.col(node).alias("n"))
