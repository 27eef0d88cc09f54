import json

import pytest

from tidemark.sources import checkpoint_files, frames, pgoutput
from tidemark.sources.frames import FrameSource, write_frames

COLUMNS = [("id", 1), ("c1", 0), ("c2", 0)]
NAMES = [n for n, _ in COLUMNS]


def stream():
    """Frames with their expected events."""
    f = pgoutput.frame_bytes
    row = lambda a, rel, before, after: pgoutput.row_bytes(a, rel, NAMES, before, after)
    return [
        f(10, pgoutput.begin_bytes(99, 7)),
        f(20, pgoutput.relation_bytes(1, "s", "t", COLUMNS)),
        f(30, row("INSERT", 1, None, {"id": "1", "c1": "ä", "c2": None})),
        f(40, row("UPDATE", 1, {"id": "1", "c1": None}, {"id": "2", "c1": "b"})),
        f(45, row("INSERT", 9, None, {"id": "1"})),  # a relation that was never announced
        pgoutput.keepalive_bytes(50, True),
        f(60, row("DELETE", 1, {"id": "2"}, None)),
        f(70, pgoutput.commit_bytes(98, 99)),
        f(80, pgoutput.begin_bytes(199, 8)),
        f(85, b"T" + bytes(9)),
        f(90, pgoutput.commit_bytes(198, 199)),
        f(95, b"U\0\0"),
        b"?",
        f(100, pgoutput.begin_bytes(299, 9)),
        f(110, pgoutput.relation_bytes(1, "s", "t2", COLUMNS[:2])),
        f(120, row("INSERT", 1, None, {"id": "5", "c1": "x", "c2": "beyond the width"})),
        f(130, b"Z"),
    ]


def test_frames_to_events(spark):
    df = spark.createDataFrame(list(enumerate(stream())), "seq long, frame binary").repartition(3)
    parsed = pgoutput.parse(df)
    got = sorted(pgoutput.changes(parsed).collect(), key=lambda r: r.seq)
    short = [(r.seq, r.txn_id, r.commit_lsn, r.action, r.table_name, r.key_names, r.before_image, r.after_image) for r in got]
    assert short == [
        (2, 7, 99, "INSERT", "t", ["id"], None, {"id": "1", "c1": "ä", "c2": None}),
        (3, 7, 99, "UPDATE", "t", ["id"], {"id": "1", "c1": None}, {"id": "2", "c1": "b"}),
        (6, 7, 99, "DELETE", "t", ["id"], {"id": "2"}, None),
        (10, 8, 199, "COMMIT", "", [], None, None),
        (15, 9, None, "INSERT", "t2", ["id"], None, {"id": "5", "c1": "x"}),
    ]
    payload = len(stream()[2]) - 25
    assert [r.lsn for r in got] == [30 + payload, 40 + len(stream()[3]) - 25, 99, 199, 120 + len(stream()[15]) - 25]
    counted = {(r.kind, r.name): r.n for r in pgoutput.counts(parsed).collect()}
    assert counted[("error", None)] == 3 and counted[("ignored", "truncate")] == 1 and counted[("insert", None)] == 3
    assert sorted(r.seq for r in pgoutput.dead_letters(parsed).collect()) == [11, 12, 16]
    assert pgoutput.changes(pgoutput.parse(df.limit(0))).count() == 0


def test_cut_messages_never_raise():
    whole = pgoutput.row_bytes("UPDATE", 1, NAMES, {"id": "1"}, {"id": "2", "c1": None})
    assert pgoutput.parse_message(whole)["kind"] == "update"
    assert all(pgoutput.parse_message(whole[:n])["kind"] == "error" for n in range(len(whole)))
    assert pgoutput.demux(b"")["type"] == "error" and pgoutput.demux(pgoutput.keepalive_bytes(5, True)) == {"type": "keepalive", "wal_start": 5, "reply": True}
    assert len(pgoutput.keepalive_reply(7, 0)) == 34


def test_options_slots_and_checkpoints(tmp_path, spark):
    url, taken = pgoutput.source_options("postgres://u@h/db?slot_name=a&x=1&publication_names=p")
    assert url == "postgres://u@h/db?x=1" and taken == {"slot_name": "a", "publication_names": "p"}
    with pytest.raises(ValueError, match="slot_name and publication_names"):
        pgoutput.source_options("postgres://h/db")

    def create(name):
        raise RuntimeError(f"slot {name} already exists")

    assert pgoutput.slot_ready(create, "a") is False and pgoutput.slot_ready(lambda n: None, "a") is True
    with pytest.raises(ZeroDivisionError):
        pgoutput.slot_ready(lambda n: 1 / 0, "a")

    folder = str(tmp_path / "ck")
    assert checkpoint_files.load(folder, "pg", "a") is None
    path = checkpoint_files.save(folder, "pg", "a", 900, 1700000000)
    assert path.endswith("pg_a_ckpt.json") and checkpoint_files.load(folder, "pg", "a") == 900
    assert json.loads(open(path).read())["checkpoint_data"] == {"lsn": "900"}
    (tmp_path / "ck" / "pg_b_ckpt.json").write_text('{"checkpoint_data": {"lsn": "x"}, "extra": 1}')
    (tmp_path / "ck" / "pg_c_ckpt.json").write_text("{")
    (tmp_path / "ck" / "pg_d_ckpt.json.tmp").write_text(open(path).read())
    assert checkpoint_files.load(folder, "pg", "b") is None
    with pytest.raises(ValueError):
        checkpoint_files.load(folder, "pg", "c")
    force = checkpoint_files.in_force(checkpoint_files.scan(spark, folder)).collect()
    assert [tuple(r) for r in force] == [("pg", "a", 900)]


def test_frame_files_in_batch_and_stream(spark, tmp_path):
    spark.dataSource.register(FrameSource)
    folder, ack = tmp_path / "frames", tmp_path / "ack.json"
    all_frames = stream()
    write_frames(folder, 0, all_frames[:9])
    options = {"path": str(folder), "slot_name": "s", "publication_names": "p"}
    batch = spark.read.format("change_frames").options(**options).load()
    assert [bytes(r.frame) for r in batch.orderBy("seq").collect()] == all_frames[:9]
    with pytest.raises(Exception, match="slot_name"):
        spark.read.format("change_frames").options(path=str(folder)).load().collect()

    def take():
        s = spark.readStream.format("change_frames").options(**options, max_frames="4", ack=str(ack), start="2").load()
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    take()
    write_frames(folder, 9, all_frames[9:])
    take()  # goes on where it was
    out = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [r.seq for r in out] == list(range(2, len(all_frames))) and [bytes(r.frame) for r in out] == all_frames[2:]
    assert 2 <= json.loads(ack.read_text())["frame"] <= len(all_frames)
    reader = frames.FrameStreamReader({**options, "max_frames": 5, "throttle": str(tmp_path / "hot")})
    assert reader.latestOffset() == {"frame": 5} and reader.latestOffset() == {"frame": 10}
    (tmp_path / "hot").touch()
    assert reader.latestOffset() == {"frame": 10}  # nothing new while throttled
    with pytest.raises(FileNotFoundError):
        frames.probe(str(tmp_path / "nowhere"))
