"""Edges that arrive in batches, and their closure kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.closure import closure
from quillgraph.session import shared_dir


class IncrementalClosure:
    """The closure of all edges (``subject``, ``object``) seen so far. A batch adds the pairs that its new edges open: what reaches
    them, they, and what they reach; old pairs are not derived again.

    The pairs are tables in the folder ``at``, one version for each batch, so that they outlive the driver: a new object on the same
    folder goes on from the last whole version. A batch that comes again, as after a restart, is worked on the version before it.
    """

    def __init__(self, spark: SparkSession, at: str | None = None):
        self.spark = spark
        self._open(at or f"{shared_dir(spark)}/incremental-{uuid.uuid4().hex[:12]}")

    def _open(self, at: str) -> None:
        self.at, path = at.rstrip("/"), self.spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.at).getFileSystem(self.spark._jsc.hadoopConfiguration())
        self.versions = sorted(self._whole())

    def _whole(self) -> list[int]:
        if not self._fs.exists(self._path(self.at)):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(self.at))]
        return [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and self._fs.exists(self._path(f"{self.at}/{n}/_SUCCESS"))]

    def _read(self, versions: list[int]) -> DataFrame:
        schema = "subject string, object string"
        return self.spark.read.schema(schema).parquet(f"{self.at}/v{versions[-1]}") if versions else self.spark.createDataFrame([], schema)

    @property
    def pairs(self) -> DataFrame:
        return self._read(self.versions)

    def add(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Adds a batch's edges; batches count from 0, and without ``batch_id`` the next number is taken."""
        n = (self.versions[-1] + 1 if self.versions else 0) if batch_id is None else batch_id
        before = [v for v in self.versions if v < n]
        pairs = self._read(before)
        new = batch.select("subject", "object").dropna().distinct().join(pairs, ["subject", "object"], "left_anti")
        ends = new.select(F.col("subject").alias("n")).union(new.select("object")).distinct()
        # old pairs that touch a new edge's end on the inside, with the new edges, are all that new paths are made of
        bridge = pairs.join(ends.withColumnRenamed("n", "object"), "object", "left_semi").select("subject", "object")
        onward = pairs.join(ends.withColumnRenamed("n", "subject"), "subject", "left_semi").select("subject", "object")
        found = closure(new.union(bridge).union(onward).distinct(), by=()).select("subject", "object")
        pairs.union(found).distinct().write.mode("overwrite").parquet(f"{self.at}/v{n}")
        # the version before stays until the next batch, as this one may come again
        for v in before[:-1]:
            self._fs.delete(self._path(f"{self.at}/v{v}"), True)
        self.versions = [*before[-1:], n]

    def start(self, edges: DataFrame, checkpoint: str) -> StreamingQuery:
        """A query that adds every batch; the pairs are kept beside its checkpoint, and a restart goes on with both."""
        self._open(f"{checkpoint.rstrip('/')}-pairs")
        return edges.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).start()
