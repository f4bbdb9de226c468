"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step moves every link towards the smallest neighbour, with grouped minima and joins only: no component,
however large, meets in one task. Lineage is cut in the shared folder after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b), a > b. Large: neighbours above a node move to its minimum; small: those below it and the node itself."""
    ways = links.select(F.col("b").alias("u"), F.col("a").alias("v")).unionAll(links.select(F.col("a").alias("u"), F.col("b").alias("v"))) if large else links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = ways.join(least, "u")
    out = moved.where("v > u") if large else moved
    out = out.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of `links` (a, b) the smallest node it reaches, itself included."""
    now = scratch(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        sign = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if sign == before or sign[0] == 0:
            break
        before = sign
        now = scratch(_star(_star(now, True), False), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
