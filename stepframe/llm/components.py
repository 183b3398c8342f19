"""Connected components of a link table by hooking and contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.shared import materialise


def _replace(df: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """df with `column` mapped through roots (v, root) where it has an entry."""
    return df.join(roots.withColumnsRenamed({"v": column}), column, "left").withColumn(column, F.coalesce("root", column)).drop("root")


def components(links: DataFrame) -> DataFrame:
    """(v, root) for every vertex of links (a, b) but the roots; root is the least vertex of the component.

    Each round every vertex that has a smaller neighbour hooks onto the least one; chains are shortened by pointer
    jumping, the links are mapped to the roots, and links within a root vanish. Only local minima stay roots, at most
    half of the vertices of a component, so the rounds are logarithmic. A star, however large, ends in one round.
    """
    edges = materialise(links.select("a", "b").where("a <> b").distinct())
    mapping = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("v"), F.col("a").alias("root")))
        hooks = materialise(both.groupBy("v").agg(F.min("root").alias("root")).where("root < v"))
        while True:
            jumped = materialise(_replace(hooks.withColumnRenamed("root", "r"), "r", hooks).withColumnRenamed("r", "root"))
            moved = not jumped.join(hooks.withColumnRenamed("root", "old"), "v").where("root <> old").isEmpty()
            hooks = jumped
            if not moved:
                break
        if mapping is None:
            mapping = hooks
        else:
            mapping = materialise(_replace(mapping.withColumnRenamed("root", "r"), "r", hooks).withColumnRenamed("r", "root").unionByName(hooks))
        edges = materialise(_replace(_replace(edges, "a", hooks), "b", hooks).select("a", "b").where("a <> b").distinct())
    return mapping if mapping is not None else edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
