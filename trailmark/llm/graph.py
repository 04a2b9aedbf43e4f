"""Connected components of a link table by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import Staging


def components(links: DataFrame, staging: Staging, name: str) -> tuple[DataFrame, str]:
    """(node, component) for every node of ``links`` (a, b), and the staged table behind it; the component is its
    smallest node.

    Alternates large stars (larger neighbours move to the smallest neighbour) and small stars (smaller ones
    do) until the links are stars. Each of the two is one shuffle: a node's links meet sorted in one task, in a
    window's buffer, which spills, so a hub's are two numbers a link on disk and no list in memory. Links never get
    more. A large star also sees whether it was given stars: where a node has a smaller neighbour, that is its
    only one. Each round is a written table.
    """
    around = Window.partitionBy("u").orderBy("v")

    def starred(edges: DataFrame) -> DataFrame:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        rows = both.select("u", "v", F.first("v").over(around).alias("least"), F.lag("v").over(around).alias("before"))
        rows = rows.where("before is null or before <> v")
        rows = rows.withColumn("open", F.expr("least < u and v <> least")).where("v > u or open")
        return rows.select("u", "v", F.least("least", "u").alias("m"), "open", F.col("before").isNull().alias("leads"))

    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    step = 0
    stars = staging.keep(starred(edges), f"{name}-0")
    while not stars.where("open").isEmpty():
        moved = stars.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.select("u", "v", F.first("v").over(around).alias("m"))
        edges = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        step += 1
        stars = staging.keep(starred(edges), f"{name}-{step}")
        staging.drop(f"{name}-{step - 1}")
    # A star's first row also names its middle.
    nodes = F.explode(F.when(F.col("leads"), F.array("v", "u")).otherwise(F.array("v")))
    return stars.select(nodes.alias("node"), F.col("u").alias("component")), f"{name}-{step}"
