"""Connected components of a link table, by alternating large and small stars.

Defined cases: repeated and reversed links, and links of a node with itself, change
nothing; nodes are not null; an empty table gives an empty result.  Nodes name rows, so
the length of texts plays no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import stored


def _with_low(edges: DataFrame, key: str) -> DataFrame:
    """Edges (u, v) with the lowest node among u and its v's.  Aggregated before
    the shuffle and joined back, so that a hub's edges may be split over tasks."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("low"))
    return edges.join(low, "u").select("u", "v", "low")


def components(links: DataFrame) -> DataFrame:
    """(a, b) links, of any comparable type -> (node, root): the smallest node
    of the component for every linked node; the root itself is not listed.
    Every round is written to the shared folder; rounds end when nothing moves."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_with_low(both, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .filter("u <> v").distinct())
        large = stored(large, "large-star")
        low = _with_low(large, "u")
        small = (low.select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionAll(low.select("u", F.col("low").alias("v"))).filter("u <> v").distinct())
        edges = stored(small, "small-star")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
