"""Connected components of a link table by alternating star contraction.

Every round is two aggregations and two joins on the links; no neighbour list
is ever collected, so a hub only costs one row per task after the partial
aggregation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critiq.llm.common import shared_table


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .union(least.select("u", "m")).filter("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: non-null longs) -> (node, root): for every node that has a
    link to another node, the least node of its component.  No links: empty."""
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, before = shared_table(e, "links"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                e.select("b", "b").distinct())
        before = now
        e = shared_table(_small_star(_large_star(e)), "links")
