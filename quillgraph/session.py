"""The shared folder of a session, and tables kept in it."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session has none one is made and set, in local mode; on a cluster, whose machines would not see it, that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        at = f"file://{tempfile.mkdtemp(prefix='quillgraph-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Rows that a file of a kept table has at least, where their number is known.
FILE_ROWS = 20_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end in here leave no shuffle files behind: what they wrote is all that is read again."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class Kept:
    """Tables written to the shared folder, so that later jobs neither repeat the work nor carry its lineage.

    A lost executor loses nothing of them. ``drop`` removes a table once nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """``df``, written and read again. ``rows`` is about how many it has at most: where partitions are many and small, a file holds several."""
        at = f"{self.root}/{name}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        with shuffles_removed(self.spark):
            df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
