"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvet.llm.common import materialise


def _lowest(pairs: DataFrame) -> DataFrame:
    """(node, near) pairs -> node, the smallest of node and all its neighbours."""
    low = pairs.groupBy("node").agg(F.min("near").alias("low"))
    return low.select("node", F.least("node", "low").alias("low"))


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Links between long ids -> (node, root): the smallest id of each linked node's component.

    Each round is two aggregations and two joins on the node; the minimum of a node's neighbours
    is combined map-side, so a node with very many links needs no list of them, and its rows in
    the join are split by the adaptive skew handling.  Each round's links are written to the
    shared folder, which bounds the lineage.  Loops, repeated links and either direction are
    accepted; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    edges = materialise(edges.filter("hi <> lo").distinct(), "links")
    seen = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
            )
        seen = mark
        # large star: every larger neighbour is tied to the smallest of the neighbourhood
        both = edges.select(F.col("hi").alias("node"), F.col("lo").alias("near")).union(
            edges.select(F.col("lo").alias("node"), F.col("hi").alias("near"))
        )
        large = (
            both.join(_lowest(both), "node")
            .filter("near > node")
            .select(F.col("near").alias("hi"), F.col("low").alias("lo"))
            .filter("hi <> lo")
            .distinct()
        )
        large = materialise(large, "links")
        # small star: a node and its smaller neighbours are tied to the smallest of them
        down = large.select(F.col("hi").alias("node"), F.col("lo").alias("near"))
        low = _lowest(down)
        small = (
            down.join(low, "node")
            .select(F.col("near").alias("hi"), F.col("low").alias("lo"))
            .union(low.select(F.col("node").alias("hi"), F.col("low").alias("lo")))
            .filter("hi <> lo")
            .distinct()
        )
        edges = materialise(small, "links")
