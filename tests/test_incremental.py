import pytest
from pyspark.sql import types as T

from tidemark.model import FEED
from tidemark.operators.incremental import IncrementalSink, new_messages
from tidemark.session import shared_path

SCHEMA = T.StructType([T.StructField("instance_name", T.StringType()), *FEED.fields])
FILES = "write_no long, file_name string, instance_name string, source_type string, checkpoint_data string, updated_at long"


def ev(seq, txn, commit, lsn, action="INSERT", table="t", source="pg"):
    key = ["id"] if action != "COMMIT" else []
    return ("a", seq, txn, commit, source, action, "s", table, key, None, {"id": str(lsn)} if key else None, lsn)


def files(spark, lsn=60, text=None):
    return spark.createDataFrame([(1, "f.json", "a", "pg", f'{{"lsn":"{lsn}"}}' if text is None else text, 1700000000)], FILES)


def found(spark, rows, ckpt=None):
    return sorted(r.seq for r in new_messages(spark.createDataFrame(rows, SCHEMA), ckpt or files(spark)).collect())


def test_an_end_that_only_the_marker_carries(spark):
    assert found(spark, [ev(1, 1, None, 40), ev(2, 1, 50, 50, "COMMIT", ""), ev(3, 2, 70, 65)]) == [3]


def test_an_end_known_from_another_source_type(spark):
    assert found(spark, [ev(1, 1, None, 40), ev(2, 1, 90, 41, source="mysql"), ev(3, 2, 70, 65)]) == [1, 2, 3]


def test_open_transactions_copies_and_unusable_checkpoints(spark):
    assert found(spark, [ev(1, 1, None, 10), ev(2, 1, None, 10), ev(3, 2, 60, 55)]) == [1]
    for text in ("{'lsn':'60'}", '{"lsn":"60"', "[60]", '{"lsn":"-1"}', '{"lsn":6.5}', ""):
        assert found(spark, [ev(1, 1, 50, 40)], files(spark, text=text)) == [1], text
    assert found(spark, [ev(1, 1, 50, 40)], files(spark, text='{"lsn":60}')) == []
    assert found(spark, []) == []


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", ["plan", "write", "commit", "retire"])
def test_a_run_that_fails_at_any_step_loses_and_repeats_nothing(spark, step):
    sink = IncrementalSink(spark, shared_path(spark, "test-sink"), ["action"])
    first = [ev(1, 1, 70, 65), ev(2, 1, 70, 66), ev(3, 2, 50, 45), ev(4, 1, 70, 65)]
    log = spark.createDataFrame(first, SCHEMA)

    def fail(s):
        if s == step:
            raise Stop

    with pytest.raises(Stop):
        sink.run(log, files(spark), fail)
    more = spark.createDataFrame([*first, ev(5, 3, 90, 80), ev(6, 1, 70, 66)], SCHEMA)
    sink.run(more, files(spark))  # after a failure the plan of the first run is replayed
    sink.run(more, files(spark))
    sink.run(more, files(spark))
    assert sorted((r.seq, r.action) for r in sink.records().collect()) == [(1, "INSERT"), (2, "INSERT"), (5, "INSERT")]
