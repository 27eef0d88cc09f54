import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from simulator import simulate
from tidemark.model import FEED
from tidemark.operators.apply import apply_changes, key_shown

SCHEMA = T.StructType([T.StructField("instance_name", T.StringType()), *FEED.fields])


def ev(seq, action, before=None, after=None, lsn=None, names=("id",)):
    lsn = seq if lsn is None else lsn
    return ("a", seq, 1, 1000, "pg", action, "s", "t", list(names), before, after, lsn)


def state(df):
    rows = df.collect()
    got = {(r.instance_name, r.schema_name, r.table_name, r.row_key, r.column_name): r.lsn for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_p1_found_against_the_simulator(spark, sf):
    path = f"/root/testdata/{sf}"
    got = state(entry.queries()["p1_found"](spark, path))
    want = simulate([r.asDict() for r in spark.read.parquet(f"{path}/changes.parquet").collect()])
    assert got and got == want


def moves():
    """Moves, recreation and shared positions; with what comes out."""
    rows = [
        ev(1, "INSERT", None, {"id": "1", "x": "a", "y": "b"}),
        ev(2, "UPDATE", {"id": "1"}, {"id": "2", "x": "q"}),  # moved with y
        ev(3, "INSERT", None, {"id": "5", "x": "a", "y": "b"}),
        ev(4, "DELETE", {"id": "5"}),
        ev(5, "INSERT", None, {"id": "5", "x": None}),  # y is gone
        ev(6, "INSERT", None, {"id": "7", "x": "1"}),
        ev(7, "INSERT", None, {"id": "8", "x": "2"}),
        # one statement: 8 -> 9 and 7 -> 8 share a position
        ev(8, "UPDATE", {"id": "8"}, {"id": "9"}, 8),
        ev(9, "UPDATE", {"id": "7"}, {"id": "8"}, 8),
        ev(10, "UPDATE", {"id": "8"}, {"id": "8", "y": "z"}, 10),
    ]
    return rows, {("2", "x"): 2, ("2", "y"): 1, ("5", "x"): 5, ("8", "x"): 6, ("8", "y"): 10, ("9", "x"): 7}


def random_feed(seed):
    rnd, feed = random.Random(seed), []
    for n in range(1, 301):
        k, c = str(rnd.randrange(40)), rnd.choice("xyz")
        kind = rnd.random()
        if kind < 0.4:
            row = ev(n, "INSERT", None, {"id": k, c: None})
        elif kind < 0.7:
            row = ev(n, "UPDATE", None, {"id": k, c: "v"})
        elif kind < 0.85:
            row = ev(n, "DELETE", {"id": k})
        else:
            row = ev(n, "UPDATE", {"id": k}, {"id": str(rnd.randrange(40)), c: "m"})
        feed.append((*row[:7], f"t{seed}", *row[8:]))
    rnd.shuffle(feed)
    return feed + feed[:50]


def table_state(spark, rows, **kw):
    return state(apply_changes(spark.createDataFrame(rows, SCHEMA), **kw))


I, U, D = "INSERT", "UPDATE", "DELETE"
ROW = (I, None, {"id": "1", "c1": "a", "c2": "b"})
#: (number, events, expected {(key, column): number of the event that gave the value}).
GOLDEN = [
    (1, [ROW], {("1", "c1"): 1, ("1", "c2"): 1}),
    (2, [ROW, (I, None, {"id": "1", "c1": "x"})], {("1", "c1"): 2, ("1", "c2"): 1}),
    (3, [ROW, (I, None, {"id": "1"})], {("1", "c1"): 1, ("1", "c2"): 1}),
    (4, [ROW, (U, None, {"id": "1", "c1": None})], {("1", "c1"): 2, ("1", "c2"): 1}),
    (5, [ROW, (U, None, {"id": "1", "c1": "z"})], {("1", "c1"): 2, ("1", "c2"): 1}),
    (6, [(U, None, {"id": "1", "c1": "z"})], {}),
    (7, [ROW, (D, {"id": "1"}, None), (U, None, {"id": "1", "c1": "z"})], {}),
    (8, [ROW, (D, {"id": "1"}, None), (I, None, {"id": "1", "c1": "n"})], {("1", "c1"): 3}),
    (9, [(I, None, {"id": "1", "c1": "a"}), (D, {"id": "1"}, None)], {}),
    (10, [ROW, (U, {"id": "1"}, {"id": "2", "c1": "a", "c2": "b"})], {("2", "c1"): 2, ("2", "c2"): 2}),
    (11, [ROW, (U, {"id": "1"}, {"id": "2", "c1": "q"})], {("2", "c1"): 2, ("2", "c2"): 1}),
    (12, [ROW, (D, {}, None), (D, None, None)], {("1", "c1"): 1, ("1", "c2"): 1}),
    (13, [ROW, (D, {"id": None}, None)], {("1", "c1"): 1, ("1", "c2"): 1}),
    (15, [ROW, (U, {"id": None}, {"id": "1", "c1": "z"})], {("1", "c1"): 1, ("1", "c2"): 1}),
    (17, [ROW, ROW], {("1", "c1"): 2, ("1", "c2"): 2}),
]


def test_scenarios_moves_composite_keys_and_random_feeds(spark):
    """All of them at once, each in a table of its own, with a row of nulls."""
    rows, want = [], {}
    for number, events, expected in GOLDEN:
        for at, (action, before, after) in enumerate(events, 1):
            e = list(ev(number * 100 + at, action, before, after, at))
            e[7] = f"g{number}"
            rows.append(tuple(e))
        want |= {("a", "s", f"g{number}", *k): v for k, v in expected.items()}
    moved, expected = moves()
    rows += [(*r[:7], "moves", *r[8:]) for r in moved]
    want |= {("a", "s", "moves", *k): v for k, v in expected.items()}
    keyless = ev(1, I, None, {"c1": "a"}, names=())
    other = ev(2, D, {"k1": "1", "k2": "3"}, None, names=("k1", "k2"))
    feeds = [r for seed in range(4) for r in random_feed(seed)]
    alike = [
        ev(1, I, None, {"k": "a|b", "l": "c", "x": "1"}, names=("k", "l")),
        ev(2, I, None, {"k": "a", "l": "b|c", "x": "2"}, names=("k", "l")),
        ev(3, I, None, {"k": "a\\", "l": "c", "x": "3"}, names=("k", "l")),
        ev(4, D, {"k": "a", "l": "b|c"}, None, names=("k", "l")),
    ]
    alike = [(*r[:7], "alike", *r[8:]) for r in alike]
    plain = T.StructType([T.StructField(f.name, f.dataType) for f in SCHEMA])
    df = spark.createDataFrame([*rows, keyless, other, *feeds, *alike, (None,) * len(plain)], plain)
    df = apply_changes(df)
    got = state(df)
    want |= simulate([dict(zip(SCHEMA.names, r)) for r in feeds])
    assert {k: v for k, v in got.items() if k[2] != "alike"} == want
    shown = df.filter("table_name = 'alike'").select(key_shown(F.col("row_key")).alias("k"), "lsn")
    assert sorted(map(tuple, shown.collect())) == [("a\\|c", 3), ("a|b|c", 1)]


def test_any_number_of_batches_and_a_base_give_the_same(spark):
    rnd, rows = random.Random(9), []
    for n in range(1, 241):
        k, c = str(rnd.randrange(25)), rnd.choice("abcdefghijk")  # more columns than one record holds
        kind = rnd.random()
        row = ev(n, I, None, {"id": k, **({c: "v"} if rnd.random() < 0.9 else {})})
        if kind > 0.45:
            row = ev(n, U, None, {"id": k, c: "v"})
        if kind > 0.75:
            row = ev(n, D, {"id": k}, None)
        if kind > 0.92:
            row = ev(n, U, {"id": k}, {"id": str(rnd.randrange(25)), c: "m"})
        rows.append((*row[:3], n, *row[4:]))  # each its own commit
    want = simulate([dict(zip(SCHEMA.names, r)) for r in rows])
    assert table_state(spark, rows, batches=5) == want
    first = apply_changes(spark.createDataFrame(rows[:120], SCHEMA), batches=1, presence=True)
    second = apply_changes(spark.createDataFrame(rows[120:], SCHEMA), base=first, presence=True)
    got = {(r.instance_name, r.schema_name, r.table_name, r.row_key, r.column_name): r.lsn for r in second.collect() if r.column_name is not None}
    assert got == want


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([ev(1, I, None, {"id": "1", "start": "a", "row_key": "b"})], SCHEMA)
    assert {k[4] for k in state(apply_changes(df.selectExpr("*", "1 as pos", "2 as grp", "3 as born")))} == {"start", "row_key"}
    assert apply_changes(df.limit(0)).count() == 0
