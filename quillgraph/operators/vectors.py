"""Embedding tables: averages, similarity of all pairs, search, projection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR_GUARD = 2_000_000_000
#: Bytes of vectors that are broadcast at once.
BLOCK_BYTES = 32 << 20


def _norm(v):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def average(df: DataFrame, key: str, vector: str = "embedding", skip: str | None = None) -> DataFrame:
    """(``key``, ``embedding``): each key's mean vector at unit length; a zero mean stays zero. Mixed dimensions are an error.

    ``skip`` names rows to leave out, as a SQL condition.
    """
    rows = df if skip is None else df.filter(f"not coalesce({skip}, false)")
    size = rows.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).first()
    if size["lo"] != size["hi"]:
        raise ValueError(f"vectors of {size['lo']} and {size['hi']} components")
    n = size["hi"] or 0
    if not n:
        return rows.select(key, F.col(vector).cast("array<double>").alias("embedding")).limit(0)
    # one pass with partial sums by component: no explosion of rows
    sums = rows.groupBy(key).agg(*[F.avg(F.element_at(vector, i + 1).cast("double")).alias(f"_{i}") for i in range(n)])
    mean = F.array(*[F.col(f"_{i}") for i in range(n)])
    made = sums.select(key, mean.alias("m")).withColumn("n", _norm(F.col("m")))
    return made.select(key, F.transform("m", lambda x: x / F.when(F.col("n") == 0, 1.0).otherwise(F.col("n"))).alias("embedding"))


def semsim(one: DataFrame, two: DataFrame, key: str, threshold: float) -> DataFrame:
    """(``a``, ``b``, ``score``): pairs with at least the cosine ``threshold``; zero vectors have no pairs. More than two thousand million pairs are an error."""
    n, m = one.count(), two.count()
    if n * m > PAIR_GUARD:
        raise ValueError(f"{n} x {m} pairs are more than {PAIR_GUARD}")

    def unit(df: DataFrame, name: str) -> DataFrame:
        v = df.select(F.col(key).alias(name), F.col("embedding").cast("array<double>").alias("v")).withColumn("n", _norm(F.col("v"))).filter("n > 0")
        return v.select(name, F.transform("v", lambda x: x / F.col("n")).alias(f"v{name}"))

    # one side in blocks of known size, each broadcast: a set of queries against all rows
    one, two, flipped = (two, one, True) if m > n else (one, two, False)
    width = max(1, two.agg(F.max(F.size("embedding"))).first()[0] or 1)
    blocks = max(1, -(-min(n, m) * 8 * width // BLOCK_BYTES))
    held = unit(two, "b").withColumn("block", F.pmod(F.xxhash64("b"), F.lit(blocks)))
    pairs = reduce(DataFrame.union, [unit(one, "a").crossJoin(F.broadcast(held.filter(F.col("block") == k).drop("block"))) for k in range(blocks)])
    ids = (F.col("b").alias("a"), F.col("a").alias("b")) if flipped else ("a", "b")
    return pairs.select(*ids, _dot(F.col("va"), F.col("vb")).alias("score")).filter(F.col("score") >= threshold)


def search(df: DataFrame, query: list[float], key: str, k: int) -> DataFrame:
    """(``key``, ``score``): the ``k`` keys with the best cosine to ``query``, of each key its best vector; ties by key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    size = sum(x * x for x in query) ** 0.5
    v = df.select(key, F.col("embedding").cast("array<double>").alias("v")).withColumn("n", _norm(F.col("v"))).filter("n > 0")
    scored = v.select(key, (_dot(F.col("v"), q) / F.col("n") / size).alias("score"))
    return scored.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(k)


def project(df: DataFrame, components: list[list[float]], mean: list[float], vector: str = "embedding") -> DataFrame:
    """``df`` with ``projection``: each vector less the mean, on each of the components."""
    m = F.array(*[F.lit(float(x)) for x in mean])
    centred = F.zip_with(F.col(vector).cast("array<double>"), m, lambda x, y: x - y)
    return df.withColumn("projection", F.array(*[_dot(centred, F.array(*[F.lit(float(x)) for x in c])) for c in components]))


def principal_components(df: DataFrame, k: int, vector: str = "embedding") -> tuple[list[list[float]], list[float]]:
    """The ``k`` first principal components and the mean; the covariance is summed on the executors, its size is the dimension's square."""
    import numpy as np

    n = df.select(F.max(F.size(vector))).first()[0] or 0
    x = [F.element_at(vector, i + 1).cast("double") for i in range(n)]
    row = df.agg(F.count("*"), *[F.sum(c) for c in x], *[F.sum(x[i] * x[j]) for i in range(n) for j in range(i, n)]).first() if n <= 32 else None
    if row is None:

        def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """A partition's sums: one row for each pair of components, whatever the number of vectors."""
            gram, total, count = np.zeros((n, n)), np.zeros(n), 0
            for part in parts:
                v = np.stack([np.asarray(x, float) for x in part["v"]]) if len(part) else np.zeros((0, n))
                gram, total, count = gram + v.T @ v, total + v.sum(0), count + len(v)
            i, j = np.divmod(np.arange(n * n), n)
            yield pd.DataFrame({"i": i, "j": j, "ab": gram.ravel(), "a": total[i], "c": count})

        sums = df.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(moments, "i int, j int, ab double, a double, c long")
        second, total, count = np.zeros((n, n)), np.zeros(n), 1
        for i, j, ab, a, c in sums.groupBy("i", "j").agg(F.sum("ab"), F.sum("a"), F.sum("c")).collect():  # the dimension's square
            second[i, j], total[i], count = ab, a, c
    else:
        count, total = row[0] or 1, np.array(row[1 : n + 1], float)
        second = np.zeros((n, n))
        second[np.triu_indices(n)] = row[n + 1 :]
        second = np.triu(second) + np.triu(second, 1).T
    mean = total / count
    values, vectors = np.linalg.eigh(second / count - np.outer(mean, mean))
    best = vectors[:, np.argsort(-values)[:k]].T
    best *= np.sign(best[np.arange(len(best)), np.abs(best).argmax(1)])[:, None]
    return best.tolist(), mean.tolist()


def new_rows(df: DataFrame, cached: DataFrame, by: str = "hash") -> DataFrame:
    """Rows whose content hash has no embedding yet."""
    return df.join(cached.select(by).distinct(), by, "left_anti")


def best_per_key(df: DataFrame, key: str, score: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score)))).filter(F.col("rank") <= k)
