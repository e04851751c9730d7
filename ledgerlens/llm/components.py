"""Connected components of an edge list, by alternating large and small stars.

Each step is a grouped minimum and an equi-join on the node, so a node with a
third of all edges is pre-aggregated map-side and its join partition can be
split. Nothing is gathered on the driver but one pair of numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Link the neighbours of each node that ``keep`` selects to the least
    node of its neighbourhood (itself included)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (pairs.join(least, "u").where(keep)
            .select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)``: ``label`` is the
    least node of its component. Self-links and NULL ends are dropped; an
    empty edge list gives no rows."""
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        # Large star: every greater neighbour of u goes to the least of u's neighbourhood.
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, F.col("v") > F.col("u"))
        # Small star: u and its lesser neighbours go to the least of them.
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        itself = down.select("u", F.col("u").alias("v")).distinct()
        links = materialize(_star(down.union(itself), F.lit(True)))
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).union(
        roots.select("node", F.col("node").alias("label")))
