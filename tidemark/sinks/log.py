"""Sinks for looking at what passes: a line for each batch, or the rows kept in memory for tests."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.control.registry import SINKS


class LogSink:
    """Writes the number of events by action of each batch."""

    def __init__(self, name: str = "log", write: Callable[[str], None] = logging.getLogger("tidemark.sink").info):
        self.name, self.write = name, write

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        counts = {r.action: r.n for r in batch.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.write(f"batch={batch_id} total={sum(counts.values())} " + " ".join(f"{k}={counts[k]}" for k in sorted(counts, key=str)))

    def probe(self) -> None:
        pass

    def close(self) -> None:
        pass


class AppendSink:
    """Appends each batch to a folder, one part for each batch id: a batch that comes again replaces its own part."""

    def __init__(self, name: str, path: str):
        self.name, self.path = name, path.rstrip("/")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def probe(self) -> None:
        pass

    def close(self) -> None:
        pass


SINKS.register("log")(LogSink)
SINKS.register("append")(AppendSink)
