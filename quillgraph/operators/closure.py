"""Transitive closure of labelled edges by semi-naive rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import Kept


def closure(edges: DataFrame, by: tuple[str, ...] = ("predicate",), reflexive: bool = False, max_depth: int | None = None) -> DataFrame:
    """(``subject``, *by, ``object``, ``depth``): all reachable pairs with their least number of steps.

    Edges with different values of ``by`` do not compose. Each round extends only the pairs that the round before
    found, and keeps its pairs as a table, so neither work nor lineage grows with the rounds. Cycles end by
    themselves: a pair is extended once, so that the rounds are as many as the longest of the shortest walks, whatever that is. ``reflexive``
    adds every node to itself at depth 0. ``max_depth`` ends the walk early.
    """
    kept = Kept(edges.sparkSession, "closure")
    keys = [*by]
    base = kept.keep(edges.select("subject", *keys, "object").dropna().distinct(), "edges")
    step = base.select(F.col("subject").alias("_mid"), *keys, F.col("object").alias("_next"))
    seen = kept.keep(base.withColumn("depth", F.lit(1)), "d1")
    parts, fresh, depth = [seen], seen, 1
    while max_depth is None or depth < max_depth:
        grown = fresh.withColumnRenamed("object", "_mid").join(step, ["_mid", *keys]).select("subject", *keys, F.col("_next").alias("object")).distinct()
        for p in parts:
            grown = grown.join(p.select("subject", *keys, "object"), ["subject", *keys, "object"], "left_anti")
        depth += 1
        fresh = kept.keep(grown.withColumn("depth", F.lit(depth)), f"d{depth}")
        if fresh.isEmpty():
            break
        parts.append(fresh)
        if len(parts) > 8:  # few large tables are better to subtract than many small ones
            merged = parts[0]
            for p in parts[1:]:
                merged = merged.unionByName(p)
            parts = [kept.keep(merged, f"all{depth}")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if reflexive:
        nodes = base.select(F.col("subject").alias("n"), *keys).union(base.select(F.col("object").alias("n"), *keys)).distinct()
        own = nodes.select(F.col("n").alias("subject"), *keys, F.col("n").alias("object"), F.lit(0).alias("depth"))
        out = out.filter("subject != object").unionByName(own)
    return out


def paths(edges: DataFrame, by: tuple[str, ...] = ("predicate",)) -> DataFrame:
    """As ``closure``, but one row for each walk, as recursion without a cycle guard counts them.

    Rounds double the length: walks of exactly ``n`` steps, put before all shorter ones, give those of up to ``2n``. Walks of any
    length are found; a cycle, which a walk comes back on within as many steps as it has edges, raises.
    """
    kept = Kept(edges.sparkSession, "paths")
    keys = [*by]
    every = kept.keep(edges.select("subject", *keys, "object").withColumn("depth", F.lit(1)), "upto1")
    last, length = every, 1
    while True:
        if not every.filter("subject = object").isEmpty():
            raise RuntimeError("the edges have a cycle")
        if last.isEmpty():
            return every
        front = last.select("subject", *keys, F.col("object").alias("_mid"), F.col("depth").alias("_n"))
        longer = front.join(every.withColumnRenamed("subject", "_mid"), ["_mid", *keys]).select("subject", *keys, "object", (F.col("_n") + F.col("depth")).alias("depth"))
        every = kept.keep(every.unionByName(longer), f"upto{2 * length}")
        last, length = every.filter(F.col("depth") == 2 * length), 2 * length
