import __spark_entry__ as entry
from tidemark.llm.mix import mix

DOCS = "doc_id long, source string, http_status int, text string, n_tokens string"
TARGETS = "source string, target_share double, max_repeats int, have string"


def test_p7_mix_reaches_the_shares(spark):
    sf = "/root/testdata/sf0.01"
    report = {r.source: r for r in entry.queries()["p7_report"](spark, sf).collect()}
    targets = {r.source: r for r in spark.read.parquet(f"{sf}/mix_targets.parquet").collect()}
    used = entry.queries()["p7_mix"](spark, sf).collect()
    assert set(report) == set(targets) and len({r.doc_id for r in used}) == len(used)
    assert all(0 < r.repeats <= targets[r.source].max_repeats for r in used)
    assert report["radio_scripts"].tokens == 0
    live = sum(r.target_share for r in report.values() if r.tokens)
    for r in report.values():
        assert r.tokens == sum(u.n_tokens * u.repeats for u in used if u.source == r.source)
        if r.tokens:
            assert abs(r.actual_share - r.target_share / live) < 0.02


def test_whole_epochs_come_first_and_the_rest_is_drawn_by_weight(spark):
    rows = [(i, "big", 200, "word " * 10 if i % 2 else "= + 1 " * 10, "x") for i in range(400)]
    rows += [(1000 + i, "small", 200, "word " * 10, "x") for i in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.5, 1, ""), ("small", 0.5, 4, ""), ("none", 0.3, 2, "")], TARGETS)
    chosen, report = mix(docs, targets)
    got = {r.doc_id: r for r in chosen.collect()}
    small = [r.repeats for r in got.values() if r.source == "small"]
    assert len(small) == 10 and set(small) == {4}  # the smallest source sets the budget
    big = [r for r in got.values() if r.source == "big"]
    assert {r.repeats for r in big} == {1}
    words = sum(r.doc_id % 2 for r in big)
    assert words > 0.6 * len(big)  # letters weigh more than signs
    shares = {r.source: r.actual_share for r in report.collect()}
    assert abs(shares["big"] - 0.5) < 0.05 and shares["none"] == 0


def test_nulls_unnamed_sources_repeats_and_empty_tables(spark):
    rows = [(1, None, None, "a b", None), (2, "odd", 200, "a b", None), (3, "s", None, None, None), (4, "s", 200, "", None), (5, "s", 500, "a b", None), (5, "s", 500, "a b", None)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("s", 1.0, 2, "")], TARGETS)
    chosen, report = mix(docs, targets)
    assert [(r.doc_id, r.repeats) for r in chosen.collect()] == [(5, 2), (5, 2)]
    assert [(r.source, r.actual_share) for r in report.collect()] == [("s", 1.0)]
    chosen, report = mix(docs.limit(0), targets)
    assert chosen.count() == 0 and [(r.tokens, r.actual_share) for r in report.collect()] == [(0, None)]
    assert mix(docs, targets.limit(0))[0].count() == 0
