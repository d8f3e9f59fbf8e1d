"""Connected components of an undirected graph, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import Kept

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(``node``, ``component``) of every node with an edge; the component is its smallest node.

    Each round links every node's larger neighbours to the smallest node around it, then its smaller ones.
    The number of edges never grows, the rounds grow with the logarithm of the longest path, and each
    round's edges are a table in the shared folder. Nulls and loops are ignored.
    """
    kept = Kept(edges.sparkSession, "components")
    a, b = F.col("a"), F.col("b")

    def oriented(e: DataFrame) -> DataFrame:
        return e.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = kept.keep(oriented(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))), "r0")
    seen = mark(now)
    if not seen[0]:
        return now.select(a.alias("node"), b.alias("component"))
    for i in range(1, MAX_ROUNDS + 1):
        both = now.unionByName(now.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.least(a, F.min("b")).alias("low"))
        large = oriented(both.join(low, "a").filter(b > a).select(b.alias("a"), F.col("low").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(b.alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b")))
        now = kept.keep(oriented(small), f"r{i}", rows=seen[0])
        kept.drop(f"r{i - 1}")
        if (new := mark(now)) == seen:
            roots = now.select(b.alias("node"), b.alias("component")).distinct()
            return now.select(a.alias("node"), b.alias("component")).unionByName(roots)
        seen = new
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
