"""Queries that run a stream, decode frames, or follow a controller."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.control import probe
from tidemark.control.config import Config, Performance, Retry
from tidemark.operators import fold
from tidemark.plans import catalog
from tidemark.plans.catalog import table
from tidemark.session import shared_path, ship
from tidemark.sinks.base import Progress
from tidemark.sinks.snapshot import SnapshotSink
from tidemark.sources import pgoutput
from tidemark.streaming.pipeline import SinkRunner, to_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = catalog.feed(table(spark, sf_dir, "events"))
    return f.withColumns({"lsn": F.col("seq"), "schema_name": F.lit("s"), "table_name": F.lit("t")})


def merge_fold(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """The state after a batch; events of a batch have orders of 0 or more, the state is put below them."""
    if state is None:
        return fold.fold(batch, ["k"], "seq", catalog.COLUMNS)
    return fold.merged(state, batch, ["k"], "seq", catalog.COLUMNS)


class Lost(Exception):
    """A failure made on purpose."""


@query(catalog.SQL["q_apply_fold"])
def q_stream_apply(spark, sf_dir, arrivals: int = 4):
    """The feed in arrivals, each through the log into a snapshot sink; the second one fails between write and publish."""
    root = shared_path(spark, "stream")
    feed = stream_feed(spark, sf_dir)
    end = (feed.agg(F.max("seq")).first()[0] or 0) + 1
    sink = SnapshotSink(spark, "target", f"{root}/target", merge_fold)
    retry = Retry(retries=1, base_ms=1, cap_ms=1)
    config = Config(retry=retry, performance=Performance())
    whole, failures = sink.apply, []

    def fragile(batch: DataFrame, batch_id: int) -> None:
        def fail(step: str) -> None:
            if batch_id == 1 and not failures:
                failures.append(step)
                raise Lost(step)

        whole(batch, batch_id, fail)

    sink.apply = fragile
    for i in range(arrivals):
        arrived = feed.filter((F.col("seq") >= end * i // arrivals) & (F.col("seq") < end * (i + 1) // arrivals))
        arrived.write.mode("append").parquet(f"{root}/incoming")
        to_log(spark.readStream.schema(feed.schema).parquet(f"{root}/incoming"), f"{root}/log", f"{root}/checkpoints/log").awaitTermination()
        runner = SinkRunner(spark, sink, Progress(), config, f"{root}/checkpoints/target")
        runner.start(f"{root}/log", feed.schema).awaitTermination()
    return sink.state()


# frames ---------------------------------------------------------------------------------------------------------------

_COLUMNS = [("id", 1), ("value", 0), ("props", 0)]
_NAMES = [n for n, _ in _COLUMNS]


def event_frames(events: DataFrame) -> DataFrame:
    """(seq, frame): the feed of events as a replication stream: 100 events a transaction, the relation told every 500 events,
    a keepalive and a message to be passed over every 1000, an unreadable one every 700."""
    e = events.select(
        "event_id", F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.col("value").cast("decimal(18,4)").cast("string").alias("value"), "props"
    )

    def frames(i: int, key: str, kind: str, value: str, props: str) -> Iterator[tuple[int, bytes]]:
        frame = partial(pgoutput.frame_bytes, i * 4000)
        if i % 100 == 0:
            yield 0, frame(pgoutput.begin_bytes((i // 100 * 100 + 99) * 4 + 3, i // 100))
        if i % 500 == 0:
            yield 1, frame(pgoutput.relation_bytes(16384, "s", f"v{i // 500}", _COLUMNS))
        if i % 1000 == 0:
            yield 2, pgoutput.keepalive_bytes(i * 4000, True)
            yield 3, frame(b"T" + bytes(9))
        if i % 700 == 0:
            yield 4, frame(b"I\0\0")
        action = {"signup": "INSERT", "error": "DELETE"}.get(kind, "UPDATE")
        row = {"id": key, "value": value, **({"props": props} if kind in ("signup", "purchase") else {})}
        yield 5, frame(pgoutput.row_bytes(action, 16384, _NAMES, {"id": key} if action == "DELETE" else None, row))
        if i % 100 == 99:
            yield 6, frame(pgoutput.commit_bytes(i * 4, i * 4 + 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i * 8 + n, f) for i, *rest in zip(*(c.to_pylist() for c in batch.columns)) for n, f in frames(i, *rest)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["seq", "frame"])

    ship(events.sparkSession)
    return e.mapInArrow(run, "seq long, frame binary")


@query("""with e as (select *, cast(user_id as varchar) as id, cast(cast(value as decimal(18,4)) as varchar) as v, event_id // 100 * 100 + 99 as fin,
    case event_type when 'signup' then 'INSERT' when 'error' then 'DELETE' else 'UPDATE' end as action, (select max(event_id) from events) as top from events)
select event_id as seq, event_id // 100 as txn_id, case when fin <= top then fin * 4 + 3 end as commit_lsn, action, 'v' || (event_id // 500) as table_name, ['id'] as key_names,
    case when action = 'DELETE' then map {'id': id} end as before_image,
    case when action = 'DELETE' then null when event_type in ('signup', 'purchase') then map {'id': id, 'value': v, 'props': props} else map {'id': id, 'value': v} end as after_image,
    event_id = fin as stamped from e""")
def q_decode(spark, sf_dir):
    events = pgoutput.changes(pgoutput.parse(event_frames(table(spark, sf_dir, "events"))))
    stamped = F.coalesce(F.col("lsn") == F.col("commit_lsn"), F.lit(False)).alias("stamped")
    return events.select(F.floor(F.col("seq") / 8).cast("long").alias("seq"), "txn_id", "commit_lsn", "action", "table_name", "key_names", "before_image", "after_image", stamped)


@query("""with n as (select max(event_id) + 1 as n from events)
select 'begin' as kind, null as name, (n + 99) // 100 as n from n union all select 'commit', null, n // 100 from n union all select 'relation', null, (n + 499) // 500 from n
union all select 'ignored', 'truncate', (n + 999) // 1000 from n union all select 'error', null, (n + 699) // 700 from n
union all select case event_type when 'signup' then 'insert' when 'error' then 'delete' else 'update' end, null, count(*) from events group by 1""")
def q_decode_counts(spark, sf_dir):
    return pgoutput.counts(pgoutput.parse(event_frames(table(spark, sf_dir, "events"))))


# the controller ---------------------------------------------------------------------------------------------------------


def _trace(pdf):
    rows = pdf.sort_values(["at", "flush_no"])
    states = probe.trace(zip(rows["at"], rows["batch_size"].astype(int), rows["reason"]), probe.probe(300))
    rows = rows[["sink", "flush_no"]].copy()
    rows["size"], rows["step"], rows["direction"], rows["eps"] = [s.size for s in states], [s.step for s in states], [s.direction for s in states], [s.eps for s in states]
    return rows


@query()
def q_probe_trace(spark, sf_dir):
    """What the controller would do after each flush of each sink: one row for each flush."""
    ship(spark)
    h = catalog.history(spark, sf_dir).select("sink", "flush_no", "at", "batch_size", "reason")
    return h.groupBy("sink").applyInPandas(_trace, "sink string, flush_no long, size long, step long, direction long, eps double")
