"""The engine: a source into a durable log of changes, and one query per sink from the log, each with its own checkpoint.

A slow or failing sink holds back nobody: the others read the log at their own pace, and the source is acknowledged up to
what the log holds. Batches of one sink follow one another; a sink sees a batch again only after a failure, with the same
number.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.control.config import Config, problems, runnable
from tidemark.control.health import Health, check_all
from tidemark.control.retry import GaveUp, retried
from tidemark.operators.progress import table_filter
from tidemark.sinks.base import Progress, Sink

log = logging.getLogger("tidemark.engine")


def to_log(changes: DataFrame, path: str, checkpoint: str, every_ms: int | None = None) -> StreamingQuery:
    """Append a stream of changes to the log. Without every_ms it takes what is there and ends."""
    writer = changes.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every_ms is None else {"processingTime": f"{every_ms} milliseconds"}
    return writer.trigger(**trigger).start()


def lay_out(changes: DataFrame, path: str) -> None:
    """Write changes as a log that readers can skip through: one folder an instance, rows by commit position."""
    n = int(changes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = changes.repartitionByRange(n, "instance_name", "commit_lsn").sortWithinPartitions("instance_name", "commit_lsn", "lsn")
    ranged.write.mode("overwrite").partitionBy("instance_name").parquet(path)


@dataclass
class SinkRunner:
    """Feeds one sink from the log."""

    spark: SparkSession
    sink: Sink
    progress: Progress
    config: Config
    checkpoint: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    flushed: Callable[[float, int, bool], None] | None = None
    sleep: Callable[[float], None] = time.sleep
    stopped: bool = field(default=False)

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        rows = table_filter(batch, self.include, self.exclude)
        r = self.config.retry
        retried(
            lambda: self.sink.apply(rows, batch_id), r.retries, r.base_ms / 1000, r.cap_ms / 1000,
            self.config.performance.flush_timeout_ms / 1000, sleep=self.sleep, stopped=lambda: self.stopped,
        )
        got = batch.agg(F.count(F.lit(1)).alias("n"), F.max("lsn").alias("lsn")).first()
        self.progress.advance(self.sink.name, got["lsn"])
        if self.flushed:
            size = self.config.performance.batch_size
            self.flushed(time.time(), got["n"], got["n"] >= size)

    def _guarded(self, batch: DataFrame, batch_id: int) -> None:
        try:
            self._batch(batch, batch_id)
        except GaveUp:
            self.progress.fail(self.sink.name)
            raise

    def start(self, path: str, schema, files_per_batch: int | None = None, every_ms: int | None = None) -> StreamingQuery:
        """Without every_ms it applies what is in the log, in as many batches as that makes, and ends."""
        reader = self.spark.readStream.schema(schema)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        trigger = {"availableNow": True} if every_ms is None else {"processingTime": f"{every_ms} milliseconds"}
        self.progress.add(self.sink.name, self.progress.reached.get(self.sink.name))
        query = reader.parquet(path).writeStream.foreachBatch(self._guarded).queryName(f"sink-{self.sink.name}").option("checkpointLocation", self.checkpoint)
        return query.trigger(**trigger).start()


class Engine:
    """Starts what a configuration names, and stops it in order: the source, then the sinks between batches, then progress."""

    def __init__(self, spark: SparkSession, config: Config, folder: str):
        self.spark, self.config, self.folder, self.progress = spark, config, folder.rstrip("/"), Progress()
        self.runners: list[SinkRunner] = []
        self.queries: list[StreamingQuery] = []
        self.source: StreamingQuery | None = None

    @property
    def log_path(self) -> str:
        return f"{self.folder}/log"

    def bootstrap(self, sinks: dict[str, Sink], probes: dict[str, Callable[[], None]] | None = None) -> list[Health]:
        """Check the configuration and every endpoint; raises if something keeps it from running."""
        if wrong := problems(self.config):
            raise ValueError("; ".join(wrong))
        health = check_all({**{n: s.probe for n, s in sinks.items()}, **(probes or {})})
        if bad := [f"{h.name}: {h.error}" for h in health if not h.ok]:
            raise ConnectionError("; ".join(bad))
        for endpoint in runnable(self.config):
            if endpoint.name not in sinks:
                raise ValueError(f"no sink was made for {endpoint.name!r}")
            runner = SinkRunner(self.spark, sinks[endpoint.name], self.progress, self.config, f"{self.folder}/checkpoints/{endpoint.name}", endpoint.include, endpoint.exclude)
            self.runners.append(runner)
        return health

    def start(self, changes: DataFrame, files_per_batch: int | None = None, every_ms: int | None = None) -> None:
        self.source = to_log(changes, self.log_path, f"{self.folder}/checkpoints/log", every_ms)
        if every_ms is None:
            self.source.awaitTermination()
        for r in self.runners:
            self.queries.append(r.start(self.log_path, changes.schema, files_per_batch, every_ms))

    def wait(self) -> dict[str, str]:
        """Wait for the sinks to end; {sink: error} of those that failed."""
        errors = {}
        for r, q in zip(self.runners, self.queries):
            try:
                q.awaitTermination()
            except Exception as e:
                errors[r.sink.name] = str(e)[:300]
        return errors

    def stop(self) -> int:
        """Stop in order and return the position that the sinks have all reached."""
        if self.source is not None and self.source.isActive:
            self.source.stop()
        for r, q in zip(self.runners, self.queries):
            r.stopped = True
            if q.isActive:
                q.processAllAvailable()
                q.stop()
            r.sink.close()
        return self.progress.ack()
