"""Connected components of a graph of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _round(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = both.join(low, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select("u", "v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every end of an edge (columns ``u``, ``v``); a component is named by its smallest id. Self-links and
    repeats do no harm; a node that has only a self-link isn't listed. Rounds go on until nothing changes (their number grows
    with the logarithm of the longest chain)."""
    current, seen = cut(edges.select("u", "v").where("u <> v").distinct(), "edges"), None
    while True:
        current = cut(_round(_round(current, True), False), "edges")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    star = current.groupBy("u").agg(F.min("v").alias("component"))
    roots = current.select(F.col("v").alias("u")).distinct().join(star, "u", "left_anti").select("u", F.col("u").alias("component"))
    return star.unionByName(roots).select(F.col("u").alias("id"), "component")
