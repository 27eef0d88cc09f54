from collections import Counter, defaultdict

from tidemark.operators import dedup, skew
from tidemark.session import shared_path

SF = "/root/testdata/sf0.001"


def _key(r):
    before, after = r.before_image or {}, r.after_image or {}
    values = [before[k] if k in before else after.get(k) for k in r.key_names or []]
    return "|".join("\\N" if v is None else v for v in values)


def test_key_stats_against_a_loop(spark):
    changes = spark.read.parquet(f"{SF}/changes.parquet")
    n, last = Counter(), {}
    for r in changes.collect():
        if r.action in ("INSERT", "UPDATE", "DELETE") and r.key_names:
            k = (r.instance_name, r.schema_name, r.table_name, _key(r))
            n[k] += 1
            last[k] = max(last.get(k, (-1, -1, "")), (r.lsn, r.seq, r.action))
    got = {tuple(r)[:4]: tuple(r)[4:] for r in skew.key_stats(changes, 7).collect()}
    assert got == {k: (n[k], last[k][0], last[k][2]) for k in n}
    total = Counter()
    for k, c in n.items():
        total[k[1:]] += c
    assert {tuple(r) for r in skew.heavy_keys(changes).collect()} == {k for k, c in total.items() if c >= 0.02 * sum(n.values())}
    assert skew.key_stats(changes.limit(0)).count() == 0 == skew.heavy_keys(changes.limit(0)).count()


def test_one_copy_of_each_message_in_several_files(spark):
    path = shared_path(spark, "copies")
    spark.read.parquet(f"{SF}/changes.parquet").selectExpr("*", "1 as __file", "seq as __row", "array(1) as __bits").repartition(5).write.parquet(path)
    changes = spark.read.parquet(path).drop("__file", "__row")
    groups = defaultdict(list)
    for r in changes.collect():
        groups[(r.instance_name, r.lsn, r.schema_name or "", r.table_name or "", "" if r.action == "COMMIT" else _key(r))].append(r.seq)
    kept = dedup.deduplicated(changes)
    assert kept.columns == changes.columns
    assert {r.seq for r in kept.collect()} == {min(g) for g in groups.values()}
    assert sorted(r.seq for r in dedup.surplus(changes).collect()) == sorted(s for g in groups.values() for s in g if s != min(g))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # the payload stays where it is


def test_ties_nulls_and_empty(spark):
    path = shared_path(spark, "ties")
    spark.createDataFrame([(1, "a", 5), (1, "a", 5), (1, None, 7), (1, None, None), (None, "b", None)], "k long, v string, o long").write.parquet(path)
    df = spark.read.parquet(path)
    kept = dedup.keep_vectors(df, {"lsn": df.k, "v": df.v}, df.o).read(df)
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame([(1, "a", 5), (1, None, 7), (None, "b", None)], df.schema).collect()))
    none = shared_path(spark, "none")
    df.limit(0).write.parquet(none)
    df = spark.read.parquet(none)
    assert dedup.keep_vectors(df, {"lsn": df.k}, df.o).read(df).count() == 0
