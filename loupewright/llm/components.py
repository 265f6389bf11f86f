"""Connected components by large-star and small-star rounds.

Each round is two grouped minima and two joins on the edges, and its result is written to the shared
folder, so lineage stays short. A group's edges are never in one task: the minimum is a partial
aggregate, and the join of a hot node's edges with its one minimum can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupewright.llm.common import stored


def _star(edges: DataFrame) -> DataFrame:
    """Large star: link each node's larger neighbours to the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Small star: link each node and its smaller neighbours to the least of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its component, for every node of the edges (u, v) except the roots.

    Self-links and repeated edges do not matter; without edges the result is empty.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = stored(now, "edges"), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        now = stored(_small(_star(now)), "edges")
