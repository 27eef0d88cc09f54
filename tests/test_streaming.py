import sqlite3

import pytest

import __spark_entry__ as entry
from tidemark.control.config import Config, Endpoint, merged
from tidemark.control.retry import GaveUp
from tidemark.operators import fold
from tidemark.plans.streams import merge_fold, stream_feed
from tidemark.session import clean, shared_path, written
from tidemark.sinks.base import Progress
from tidemark.sinks.log import AppendSink, LogSink
from tidemark.sinks.snapshot import SnapshotSink
from tidemark.sinks.statements import StatementSink, execute
from tidemark.sources.checkpoint_files import unix_micros
from tidemark.streaming.pipeline import Engine, SinkRunner, lay_out, to_log

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.select("k", "value", "props").collect()), key=repr)


def test_a_kill_between_write_and_publish_and_a_new_query(spark):
    """The query fails for good; the next one starts from the checkpoint, sees the batch again and ends in the same table."""
    root = shared_path(spark, "stream-test")
    feed = stream_feed(spark, SF)
    feed.write.parquet(f"{root}/incoming")
    to_log(spark.readStream.schema(feed.schema).parquet(f"{root}/incoming"), f"{root}/log", f"{root}/ck/log").awaitTermination()
    config = merged(Config(), {"retry": {"retries": 1, "base_ms": 1, "cap_ms": 1}})
    sink, progress = SnapshotSink(spark, "x", f"{root}/target", merge_fold), Progress()
    whole, calls = sink.apply, []

    def broken(batch, batch_id):
        calls.append(batch_id)
        whole(batch, batch_id, lambda step: 1 / 0)

    sink.apply = broken
    query = SinkRunner(spark, sink, progress, config, f"{root}/ck/x").start(f"{root}/log", feed.schema)
    with pytest.raises(Exception):
        query.awaitTermination()
    assert sink.published() is None and not progress.active["x"] and calls == [0, 0]
    sink.apply = whole
    SinkRunner(spark, sink, progress, config, f"{root}/ck/x").start(f"{root}/log", feed.schema).awaitTermination()
    assert sink.published() == 0 and progress.ack() > 0
    before = rows_of(sink.state())
    whole(feed, 0)  # a batch that comes again changes nothing
    assert rows_of(sink.state()) == before == rows_of(fold.fold(feed, ["k"], "seq", ["value", "props"]))


def test_any_split_into_batches_gives_the_same(spark):
    feed = stream_feed(spark, SF).persist()
    want = rows_of(fold.fold(feed, ["k"], "seq", ["value", "props"]))
    sink = SnapshotSink(spark, "y", shared_path(spark, "split"), merge_fold)
    for i, (a, b) in enumerate([(0, 1), (1, 90), (90, 91), (91, 600), (600, 10**9)]):
        sink.apply(feed.filter(f"seq >= {a} and seq < {b}"), i)
    assert rows_of(sink.state()) == want


def test_engine_isolates_a_sink_and_filters_tables(spark, capsys):
    root = shared_path(spark, "engine")
    feed = stream_feed(spark, SF)
    feed.write.parquet(f"{root}/incoming")

    class Down(LogSink):
        def apply(self, batch, batch_id):
            raise OSError("down")

    ends = (Endpoint("keep", "append", include=("s.t",)), Endpoint("none", "append", exclude=("s.t",)), Endpoint("down", "log"), Endpoint("off", "log", active=False))
    config = merged(Config(), {"retry": {"retries": 1, "base_ms": 1, "cap_ms": 1}, "provider": {"type": "parquet"}})
    config = merged(config, {"consumers": [e.__dict__ for e in ends]})
    sinks = {"keep": AppendSink("keep", f"{root}/keep"), "none": AppendSink("none", f"{root}/none"), "down": Down("down")}
    engine = Engine(spark, config, f"{root}/state")
    assert all(h.ok for h in engine.bootstrap(sinks))
    engine.start(spark.readStream.schema(feed.schema).parquet(f"{root}/incoming"))
    errors = engine.wait()
    assert list(errors) == ["down"] and engine.stop() == feed.agg({"seq": "max"}).first()[0]
    assert spark.read.parquet(f"{root}/keep").count() == feed.count() and spark.read.parquet(f"{root}/none").count() == 0
    with pytest.raises(ConnectionError, match="nowhere"):
        Engine(spark, config, root).bootstrap(sinks, {"src": lambda: open("/nowhere")})
    with pytest.raises(ValueError, match="no active destination"):
        Engine(spark, Config(), root).bootstrap({})


def test_statements_reach_a_database(spark, tmp_path):
    db = str(tmp_path / "t.db")
    with sqlite3.connect(db) as c:
        c.execute('create table t ("id" text primary key, "a" text, "b" text)')

    def connect():
        return sqlite3.connect(db, timeout=30)

    kind = "seq long, commit_lsn long, lsn long, action string, schema_name string, table_name string, key_names array<string>, before_image map<string,string>, after_image map<string,string>"
    steps = [
        ("INSERT", None, {"id": "1", "a": "x", "b": "y"}), ("INSERT", None, {"id": "1", "a": "z"}), ("UPDATE", None, {"id": "1", "b": None}),
        ("INSERT", None, {"id": "2", "a": "x"}), ("UPDATE", {"id": "2"}, {"id": "3", "a": "q"}), ("DELETE", {"id": "9"}, None), ("INSERT", None, {"id": "1"}), ("UPDATE", None, {"id": "8", "a": "no"}),
    ]
    df = spark.createDataFrame([(i, i, i, a, "x", "t", ["id"], b, f) for i, (a, b, f) in enumerate(steps)], kind).repartition(4)
    sink = StatementSink("db", connect, size=3, schema=False)
    sink.probe()
    for _ in range(2):  # a batch that comes again
        sink.apply(df.filter("seq < 4 or seq > 4"), 0)
    with sqlite3.connect(db) as c:
        assert sorted(c.execute("select * from t")) == [("1", "z", None), ("2", "x", None)]
    sink.apply(df.filter("seq = 4"), 1)
    with sqlite3.connect(db) as c:
        assert sorted(c.execute("select * from t")) == [("1", "z", None), ("3", "q", None)]
        with pytest.raises(sqlite3.Error):
            execute(c, [("delete from t", []), ("no statement", [])])
        assert c.execute("select count(*) from t").fetchone() == (2,)  # the batch is undone


def test_layout_and_removal(spark):
    root = shared_path(spark, "layout")
    changes = spark.read.parquet(f"{SF}/changes.parquet")
    lay_out(changes, root)
    assert spark.read.parquet(root).count() == changes.count()
    old = written(spark.range(3), "to-remove")
    path = old.inputFiles()[0]
    assert clean(spark) > 0 and not __import__("os").path.exists(path.removeprefix("file://"))
    times = spark.createDataFrame([(1700000000,), (1700000000000,), (1700000000000000,)], "t long").select(unix_micros(__import__("pyspark").sql.functions.col("t")))
    assert {r[0] for r in times.collect()} == {1700000000000000}


def test_probe_trace_has_a_row_for_each_flush(spark):
    assert entry.queries()["q_probe_trace"](spark, SF).count() > 0
    assert issubclass(GaveUp, Exception)
