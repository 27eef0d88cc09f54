import random

from pyspark.sql import functions as F

from tidemark.operators import batching, envelope, progress
from tidemark.operators.ordering import as_of, numbered, running


def test_running_values_against_a_loop(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([None, rnd.randrange(50)])) for i in rnd.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, at int, v int")
    out = running(df, ["g"], ["at"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "b": ("max_before", F.col("v")), "w": ("min", F.col("v")), "l": ("last", F.col("v"))}, 7)
    got = {r.at: r for r in out.collect()}
    for g in ("a", "b", None):
        seen = []
        for at, v in sorted((at, v) for h, at, v in rows if h == g):
            r, before = got[at], [x for x in seen if x is not None]
            seen.append(v)
            now = [x for x in seen if x is not None]
            assert (r.s, r.m, r.b, r.w, r.l) == (sum(now) if now else None, max(now, default=None), max(before, default=None), min(now, default=None), now[-1] if now else None)
    places = {r.at: r.pos for r in numbered(df, ["g"], ["at"], partitions=5).collect()}
    for g in ("a", "b", None):
        for i, at in enumerate(sorted(at for h, at, _ in rows if h == g)):
            assert places[at] == i


def test_as_of_takes_the_newest_before(spark):
    rows = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (2, 9, "z"), (None, 3, "n")], "k int, at int, v string")
    facts = spark.createDataFrame([(1, 5, "old"), (1, 6, "new"), (1, 8, "late"), (None, 1, "null")], "k int, at int, name string")
    got = {r.at: r.name for r in as_of(rows, facts, ["k"], "at", ["name"], "known").collect()}
    assert got == {5: None, 7: "new", 9: None, 3: "null"}


def test_batches_of_a_collector(spark):
    """130 events in bags of 100 and 30, batches of 50: two full cuts, one full cut that drains nothing, a timeout of 30."""
    rows = [("a", i, 0 if i < 100 else 1, i + 1000) for i in range(130)]
    df = spark.createDataFrame(rows, "instance_name string, seq int, bag int, lsn long")
    got = [tuple(r)[1:] for r in batching.batch_checkpoints(df, ["instance_name"], ["seq"], 50, ["bag"]).orderBy("batch_no").collect()]
    assert got == [(0, 50, "size", None), (1, 50, "size", 1099), (2, 30, "timeout", 1129)]
    chunks = batching.chunked(df.limit(10), ["instance_name"], ["seq"], 4).groupBy("chunk").count().orderBy("chunk").collect()
    assert [r["count"] for r in chunks] == [3, 3, 3, 1]


def test_monotone_and_images(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([5, 3, None, 7, 7, 9])], "g string, no int, lsn long")
    assert [(r.reached, r.accepted) for r in progress.monotone(df, ["g"], ["no"]).orderBy("no").collect()] == [(5, True), (5, False), (5, False), (7, True), (7, False), (9, True)]
    cols = "array(struct(1 as flags, 'id' as name), struct(0 as flags, 'b' as name), struct(1 as flags, 'c' as name))"
    cells = "array(struct('t' as code, '1' as text), struct('n' as code, null as text), struct('u' as code, null as text), struct('t' as code, 'x' as text))"
    r = spark.range(1).select(envelope.image(F.expr(cols), F.expr(cells)).alias("m"), envelope.key_names(F.expr(cols)).alias("k")).first()
    assert r.m == {"id": "1", "b": None} and r.k == ["id", "c"]
