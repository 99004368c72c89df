"""Connected components of a table of links, by alternating large and small stars.

Each round is two groupings by a node and two joins; the links of a round are
written to the shared folder, so a lost executor costs one round. A node with
very many links is handled by partial minima and by Spark's split of skewed
joins; nothing comes to the driver but two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import blocks


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v), each link once, u > v."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        joined = links.join(least, "u")
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node of links (a, b): component is the smallest node that links reach."""
    spark = links.sparkSession
    current, path = blocks.stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    known = None
    for _ in range(most):
        mark = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_003).alias("h")).first()
        if mark == known or not mark["n"]:
            break
        known = mark
        after, next_path = blocks.stored(_star(_star(current, True), False), "links")
        blocks.drop_path(spark, path)
        current, path = after, next_path
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
