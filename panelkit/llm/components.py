"""Connected components of a link table, by alternating large and small stars.

Links are only ever grouped by node with a minimum, which combines map-side,
and joined back by node, which AQE splits when a node is hot; nothing is
collected. Every round is checkpointed into the shared folder, so a lost
executor costs at most one round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links`` (u, v) with u > v. Large star: neighbours above a node move
    to its least neighbour; small star: neighbours below it, and itself."""
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    met = both.join(least, F.col("u") == F.col("c"))
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of longs -> (node, component): every node of a link
    with the least node it reaches."""
    now = checkpointed(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == mark:
            break
        mark = tuple(sums)
        now = checkpointed(_star(_star(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
