"""Connected components of a graph of links, by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on the node; a hub's rows are pre-aggregated
before the shuffle and the joins are plain equi-joins that adaptive execution can split.
Each round is written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import discard, materialize


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over directed rows (u, v)."""
    low = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = edges.join(low, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), "m").union(low.select(F.col("u").alias("a"), "m"))
    else:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), "m")
    return out.where(F.col("a") != F.col("m")).select(F.col("a").alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link to another node; root is the smallest node that can be reached.

    Self links and null nodes are ignored, repeated links count once. No links give no rows.
    """
    edges = materialize(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links"
    )
    mark = None
    while True:
        both = edges.union(edges.select("v", "u"))
        large = materialize(_star(both, False), "large")
        # after a large star every row runs from a larger to a smaller node
        nxt = materialize(_star(large, True), "small")
        discard(edges)
        discard(large)
        edges = nxt
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = now
