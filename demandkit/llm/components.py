"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandkit.llm.text import pin

MAX_ROUNDS = 60


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the component's smallest node.

    Each round points every node's larger neighbours (large star), then its
    smaller ones (small star), at the smallest node it sees; the rounds grow
    with the logarithm of the number of nodes.  Minima are partial aggregates
    and a hub's links are dealt out by AQE's skew join.  Every round is written
    to the shared folder, so a lost executor never replays earlier rounds.
    Self-links and repeated links are allowed; no links give no rows.
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = pin(edges, "components", few_files=True)
    seen = _digest(edges)
    for _ in range(MAX_ROUNDS):
        # Large star: both directions, each node's larger neighbours move to its minimum.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: links point from larger to smaller; the smaller ones move to their minimum.
        large = pin(large, "components-large", few_files=True)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = pin(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "components", few_files=True)
        now = _digest(edges)
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
