"""A destination as a folder of snapshots: each batch is merged with the last one and published by a pointer."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.control.registry import SINKS
from tidemark.session import delete_path, path_exists, rename_path


class SnapshotSink:
    """path/batch=<id>/ holds the state after a batch, path/pointer/<id> tells that it is whole.

    merge(state, batch) gives the new state; state is None at first. A batch that comes again after it was published
    changes nothing; one that broke off is written over. KEPT snapshots stay for readers that are still at an older one.
    """

    KEPT = 2

    def __init__(self, spark: SparkSession, name: str, path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]):
        self.spark, self.name, self.path, self.merge = spark, name, path.rstrip("/"), merge

    def published(self) -> int | None:
        """The newest batch that is whole."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return None
        ids = [int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()]
        return max(ids, default=None)

    def state(self) -> DataFrame | None:
        at = self.published()
        return None if at is None else self.spark.read.parquet(f"{self.path}/batch={at}")

    def apply(self, batch: DataFrame, batch_id: int, fail: Callable[[str], None] = lambda step: None) -> None:
        at = self.published()
        if at is not None and batch_id <= at:
            return
        self.merge(self.state(), batch).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        fail("publish")
        self._publish(batch_id)
        if at is not None:
            self._drop_before(batch_id, at)

    def _publish(self, batch_id: int) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        part = jvm.org.apache.hadoop.fs.Path(f"{self.path}/pointer/.{batch_id}.tmp")
        part.getFileSystem(conf).create(part, True).close()
        rename_path(self.spark, f"{self.path}/pointer/.{batch_id}.tmp", f"{self.path}/pointer/{batch_id}")

    def _drop_before(self, batch_id: int, last: int) -> None:
        for old in range(last - self.KEPT, last):
            if old >= 0 and old != last and path_exists(self.spark, f"{self.path}/batch={old}"):
                delete_path(self.spark, f"{self.path}/pointer/{old}")
                delete_path(self.spark, f"{self.path}/batch={old}")

    def probe(self) -> None:
        self.published()

    def close(self) -> None:
        pass

    def describe(self) -> str:
        return json.dumps({"sink": self.name, "batch": self.published()})


SINKS.register("snapshot")(SnapshotSink)
