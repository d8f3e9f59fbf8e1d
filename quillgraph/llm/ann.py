"""Approximate nearest neighbours: one hierarchical navigable small-world graph per shard.

Vectors are dealt into shards of known size by a hash. In a shard, every node draws its top layer from the
usual geometric law, and nodes are numbered by falling top layer: layer ``l`` is then the first ``c[l]`` nodes, and its links a flat
array of ``c[l]`` rows. For the largest inner product, vectors get one more component that makes them equally long, which turns
inner products into cosines. Nodes enter in batches: each batch searches the graph built so far and its own
batch, keeps diverse neighbours, and its neighbours link back, shedding their least diverse links when full. A query descends greedily to the
bottom layer and explores it with a beam; all queries of a block move in step, so a step is one array operation.
Each shard gives its best, scored again in double precision on the original vectors, and the shards' results are merged.

Equal vectors are one node: only the ids that could reach a result are carried along, the smallest ``k + 1``, which loses nothing, since a
result is ``k`` ids, ties go to the smaller id, and one may be the query's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import table
from quillgraph.session import Kept

SHARD_ROWS = 6000
QUERY_BLOCK = 8192
M = 16
EF_BUILD = 64
EF_SEARCH = 160
BATCH = 256


class Graph:
    """``layers[l]`` holds the links of the first ``len(layers[l])`` nodes at layer ``l``, -1 where there is none."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = vectors, layers

    def greedy(self, q: np.ndarray, at: np.ndarray, layer: int) -> np.ndarray:
        links = self.layers[layer]
        best = np.einsum("qd,qd->q", q, self.x[at])
        live = np.arange(len(q))
        while len(live):
            near = links[at[live]]
            score = np.einsum("qd,qmd->qm", q[live], self.x[near])
            score[near < 0] = -np.inf
            pick = score.argmax(1)
            top = score[np.arange(len(live)), pick]
            better = top > best[live]
            live, near, pick = live[better], near[better], pick[better]
            at[live], best[live] = near[np.arange(len(live)), pick], top[better]
        return at

    def beam(self, q: np.ndarray, at: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best nodes found for each query (-1: none) and their inner products, best first."""
        links, n, width = self.layers[layer], len(q), self.layers[layer].shape[1]
        ids = np.full((n, ef), -1, np.int32)
        score = np.full((n, ef), -np.inf, np.float32)
        open_ = np.zeros((n, ef), bool)
        ids[:, 0], open_[:, 0] = at, True
        score[:, 0] = np.einsum("qd,qd->q", q, self.x[at])
        seen = np.zeros((n, len(links) + 1), bool)
        seen[np.arange(n), at] = True
        seen[:, -1] = True  # where -1 points
        live = np.arange(n)
        while len(live):
            pick = np.where(open_[live], score[live], -np.inf).argmax(1)
            has = open_[live, pick]
            live, pick = live[has], pick[has]
            if not len(live):
                break
            open_[live, pick] = False
            near = links[ids[live, pick]]
            new = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            got = np.einsum("qd,qmd->qm", q[live], self.x[near])
            got[~new] = -np.inf
            keep = np.flatnonzero(got.max(1) > score[live, -1])
            live_, got, near = live[keep], got[keep], near[keep]
            if len(live_):
                all_s = np.concatenate([score[live_], got], 1)
                all_i = np.concatenate([ids[live_], near], 1)
                all_o = np.concatenate([open_[live_], np.ones((len(live_), width), bool)], 1)
                order = np.argsort(-all_s, 1, kind="stable")[:, :ef]
                score[live_] = np.take_along_axis(all_s, order, 1)
                ids[live_] = np.where(np.isneginf(score[live_]), -1, np.take_along_axis(all_i, order, 1))
                open_[live_] = np.take_along_axis(all_o, order, 1) & ~np.isneginf(score[live_])
        return ids, score

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        at = np.zeros(len(q), np.int64)
        for layer in range(len(self.layers) - 1, 0, -1):
            at = self.greedy(q, at, layer)
        return self.beam(q, at, 0, ef)[0]


def _diverse(x: np.ndarray, base: np.ndarray, ids: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of candidates sorted best first, those nearer to the node than to any one kept before; then the best others, to ``most``."""
    n, c = ids.shape
    v = x[ids]
    to = np.einsum("ncd,nkd->nck", v, v)
    valid = (ids >= 0) & ~np.isneginf(score)
    kept = np.zeros((n, c), bool)
    for j in range(c):
        close = np.where(kept[:, :j], to[:, j, :j], -np.inf).max(1, initial=-np.inf) if j else np.full(n, -np.inf)
        kept[:, j] = valid[:, j] & (close < score[:, j]) & (kept.sum(1) < most)
    rank = np.where(kept, 0, np.where(valid, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, 1, kind="stable")[:, :most]
    out = np.take_along_axis(np.where(valid, ids, -1), order, 1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
    return out


def build(vectors: np.ndarray, seed: int, m: int = M, ef: int = EF_BUILD) -> tuple[Graph, np.ndarray]:
    """The graph of a shard and, for each node, the row of ``vectors`` (equally long ones) it stands for."""
    rng, n = np.random.default_rng(seed), len(vectors)
    top = np.minimum((-np.log(1 - rng.random(n)) / math.log(m)).astype(int), 12)
    order = np.argsort(-top, kind="stable")
    x, top = vectors[order], top[order]
    layers = [np.full((max(1, int((top >= level).sum())), m * (2 if level == 0 else 1)), -1, np.int32) for level in range(int(top[0]) + 1)] if n else []
    g = Graph(x, layers)
    done = 1
    while done < n:
        size = min(n - done, max(1, done // 2), BATCH)
        new = np.arange(done, done + size)
        at = np.zeros(size, np.int64)
        for level in range(len(layers) - 1, -1, -1):
            if done >= len(layers[level]):  # none of the batch is in this layer
                at = g.greedy(x[new], at, level)
                continue
            mine = new[new < len(layers[level])]
            ids, score = g.beam(x[mine], at[: len(mine)].copy(), level, ef)
            if len(mine) < size:
                at[len(mine) :] = g.greedy(x[new[len(mine) :]], at[len(mine) :], level)
            at[: len(mine)] = ids[:, 0]
            inner = x[mine] @ x[mine].T
            np.fill_diagonal(inner, -np.inf)
            score = np.concatenate([score, inner], 1)
            ids = np.concatenate([ids, np.broadcast_to(mine.astype(np.int32), inner.shape)], 1)
            best = np.argsort(-score, 1, kind="stable")[:, :ef]
            score, ids = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)
            chosen = _diverse(x, mine, ids, score, m)
            layers[level][mine, :m] = chosen
            _link_back(x, layers[level], mine, chosen)
        done += size
    return g, order


def _link_back(x: np.ndarray, links: np.ndarray, nodes: np.ndarray, chosen: np.ndarray) -> None:
    """Adds ``nodes`` to the links of those they chose."""
    src = np.repeat(nodes, chosen.shape[1])
    dst = chosen.ravel()
    ok = dst >= 0
    src, dst = src[ok], dst[ok]
    score = np.einsum("ed,ed->e", x[src], x[dst])
    order = np.lexsort((-score, dst))
    src, dst = src[order], dst[order]
    to, first, count = np.unique(dst, return_index=True, return_counts=True)
    width = links.shape[1]
    wide = np.full((len(to), min(width, int(count.max()) if len(count) else 0)), -1, np.int32)
    at = np.arange(len(dst)) - np.repeat(first, count)
    fit = at < wide.shape[1]
    wide[np.repeat(np.arange(len(to)), count)[fit], at[fit]] = src[fit]
    ids = np.concatenate([links[to], wide], 1)
    # a pair of one batch may have chosen each other
    score = np.where(ids >= 0, np.einsum("nd,ncd->nc", x[to], x[ids]), -np.inf)
    by = np.argsort(ids, 1, kind="stable")
    same = np.zeros(ids.shape, bool)
    in_order = np.take_along_axis(ids, by, 1)
    np.put_along_axis(same, by[:, 1:], in_order[:, 1:] == in_order[:, :-1], 1)
    score[same] = -np.inf
    best = np.argsort(-score, 1, kind="stable")
    ids, score = np.take_along_axis(ids, best, 1), np.take_along_axis(score, best, 1)
    full = (~np.isneginf(score)).sum(1) > width
    out = np.where(np.isneginf(score), -1, ids)[:, :width]
    if full.any():
        out[full] = _diverse(x, to[full], ids[full], score[full], width)
    links[to, : out.shape[1]] = out


def _even(v: np.ndarray) -> np.ndarray:
    """Vectors with one more component, so that all are as long as the longest."""
    v = v.astype(np.float32)
    size = (v.astype(np.float64) ** 2).sum(1)
    return np.concatenate([v, np.sqrt(np.maximum(size.max() - size, 0))[:, None].astype(np.float32)], 1) if len(v) else v


def _repeated(ids: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Where a row's id has a better place, or an equal one before, in the same row."""
    order = np.lexsort((-score, ids), axis=1)
    same = np.zeros(ids.shape, bool)
    np.put_along_axis(same, order[:, 1:], np.diff(np.take_along_axis(ids, order, 1), axis=1) == 0, 1)
    return same


def index(nodes: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a shard: (``dim``, ``shard``, ``ids``, ``vectors``, ``layers``), of ``nodes`` (``node``, ``v``). Arrays are bytes; ``layers`` has each layer's flat links."""
    shards = max(1, -(-nodes.count() // shard_rows))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("node")
        v = np.stack(part["v"].to_numpy()).astype(np.float64)
        g, order = build(_even(v), seed=int(key[1]) + 1)
        ids = part["node"].to_numpy(np.int64)[order]
        return pd.DataFrame({"dim": key[0], "shard": key[1], "ids": [ids.tobytes()], "vectors": [v[order].tobytes()], "layers": [[x.tobytes() for x in g.layers]]})

    dealt = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "v")
    return dealt.groupBy("dim", "shard").applyInPandas(run, "dim int, shard int, ids binary, vectors binary, layers array<binary>")


def search(indexed: DataFrame, queries: DataFrame, k: int, ef: int = EF_SEARCH, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(``query_id``, ``node``, ``score``): each shard's ``k`` best found for each of ``queries`` (``query_id``, ``q``).

    All queries meet all shards, in blocks: a task holds one shard and one block of queries.
    """
    blocks = max(1, -(-queries.count() // query_block))
    at = indexed.select(F.col("dim").alias("qdim"), F.col("shard").alias("qshard")).distinct()
    asked = queries.select("query_id", "q", F.size("q").alias("qdim"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("qblock")).join(at, "qdim")
    held = indexed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(key: tuple, shard: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in shard.itertuples():
            ids = np.frombuffer(row.ids, np.int64)
            v = np.frombuffer(row.vectors, np.float64).reshape(len(ids), key[0])
            layers = [np.frombuffer(x, np.int32).reshape(-1, M * (2 if level == 0 else 1)) for level, x in enumerate(row.layers)]
            g = Graph(_even(v), layers)
            for a in range(0, len(part), 512):
                some = part.iloc[a : a + 512]
                q = np.stack(some["q"].to_numpy()).astype(np.float64)
                q32 = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
                found = g.search(q32, max(ef, k))
                score = np.where(found >= 0, np.einsum("qd,qed->qe", q, v[found]), -np.inf)
                score[_repeated(ids[found], score)] = -np.inf
                order = np.lexsort((ids[found], -score), axis=1)[:, :k]
                found, score = np.take_along_axis(found, order, 1), np.take_along_axis(score, order, 1)
                ok = ~np.isneginf(score)
                out.append(pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), ok.sum(1)), "node": ids[found[ok]], "score": score[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "node": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return held.groupBy("dim", "shard", "block").cogroup(asked.groupBy("qdim", "qshard", "qblock")).applyInPandas(run, "query_id long, node long, score double")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF_SEARCH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): each query's ``k`` nearest found by inner product, itself left out.

    ``rows`` and ``queries`` have ``vec_id`` and ``embedding``. Vectors that are null, zero, or hold a null or non-finite component
    take no part, nor do rows with a null id; only vectors as long as the query's are its candidates. Ties go to the smaller
    id. Of repeated ids each different vector is a candidate, and a result holds an id once; of a repeated query id all its vectors ask, and a candidate has
    its best score. Other columns are ignored. Empty tables give an empty result.
    """
    kept = Kept(rows.sparkSession, "ann")

    def sound(df: DataFrame) -> DataFrame:
        v = F.transform("embedding", lambda c: c.cast("double"))
        bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad & F.exists("v", lambda c: c != 0))

    # equal vectors: the smallest k + 1 ids of each; the window keeps so many before it shuffles
    hashed = sound(rows).withColumn("h", F.xxhash64("v")).withColumn("h2", F.hash("v"))
    first = Window.partitionBy("h", "h2").orderBy("vec_id")
    few = kept.keep(hashed.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1), "few")
    nodes = kept.keep(few.filter("r = 1").select(F.col("vec_id").alias("node"), "h", "h2", "v"), "nodes")
    copies = few.select("h", "h2", "vec_id").join(nodes.select("h", "h2", "node"), ["h", "h2"]).select("node", "vec_id")
    indexed = kept.keep(index(nodes.select("node", "v"), shard_rows), "index")
    asked = kept.keep(sound(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")).dropDuplicates(["query_id", "q"]), "queries")
    hits = search(indexed, asked, k + 1, ef).groupBy("query_id", "node").agg(F.max("score").alias("score"))
    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    hits = hits.withColumn("r", F.row_number().over(merged)).filter(F.col("r") <= k + 1).drop("r")
    full = hits.join(copies, "node").filter(F.col("vec_id") != F.col("query_id"))
    full = full.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_hnsw(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors to every vector whose id is divisible by 20. Null and unsound vectors, null and repeated ids, ties, other columns and empty
    tables: as ``nearest``.
    """
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.filter(F.col("vec_id") % 20 == 0), k=20)
