"""What the operators of this package share: tables and gapless numbering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Buckets whose sizes are summed in one task, when numbering.
SPAN = 4096
#: Tables of ids and hashes (8 bytes each) are broadcast up to so many rows.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_pieces(parts: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, so that a worker holds little beside a batch."""
    for part in parts:
        for at in range(0, max(1, part.num_rows), rows):
            yield part.slice(at, rows)


def crc_mod(doc_id: str, divisor: int):
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(divisor))


def joined(df: DataFrame, kept: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``df`` with a written table of a few ids and hashes a row: broadcast while it has ``BROADCAST_ROWS`` at most, so that a hot key stays where it is;
    beyond that by a shuffle, in which adaptive execution splits hot keys.
    """
    return df.join(F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept, on, how)


def numbered(df: DataFrame, within: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """Gapless numbers from 0 within ``within``, in the order of (``bucket``, ``order``).

    No task gets a whole group: rows are numbered inside a bucket, and the buckets' sizes, summed before
    the shuffle, give each bucket its first number: first within spans of buckets, then over the spans. ``bucket`` is a long, with few rows in each.
    """
    sizes = df.groupBy(*within, bucket).agg(F.count("*").alias("_n")).withColumn("_span", F.floor(F.col(bucket) / SPAN))
    spans = sizes.groupBy(*within, "_span").agg(F.sum("_n").alias("_n"))
    early = Window.partitionBy(*within).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*within, "_span", F.coalesce(F.sum("_n").over(early), F.lit(0)).alias("_base"))
    before = Window.partitionBy(*within, "_span").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(spans, [*within, "_span"])
    first = first.select(*within, bucket, (F.col("_first") + F.col("_base")).alias("_first"))
    inside = Window.partitionBy(*within, bucket).orderBy(*order)
    return (
        df.withColumn("_at", F.row_number().over(inside) - 1)
        .join(first, [*within, bucket])
        .withColumn(out, F.col("_first") + F.col("_at"))
        .drop("_first", "_at")
    )
