import random

import __spark_entry__ as entry
from tidemark.llm import page_end, truncated

SF = "/root/testdata/sf0.01"
PAGE = "<html><head><title>T</title></head><body>\n<h1>Notes</h1>\n<p>The mill is old. It <b>turns</b> slowly&#46;</p>\n<footer>Imprint · Terms</footer>\n</body></html>\n"


def test_p8_found_on_plain_cases(spark):
    found = {r.doc_id for r in entry.queries()["p8_found"](spark, SF).collect()}
    assert {2949, 2142, 601, 2494, 640, 2487, 49, 2449, 1018, 2687, 373, 27} <= found  # end in mid-word or mid-sentence
    assert not {2610, 2019, 2642, 2528, 1924, 2255, 522, 1346, 924, 132, 1138, 82, 998} & found  # sentences, headings, verses, footers
    shares = entry.queries()["p8_shares"](spark, SF).collect()
    assert sum(r.cut for r in shares) == len(found) and sum(r.documents for r in shares) == 1000


def test_relation_to_the_page():
    page = PAGE.encode()
    assert page_end.relation("Notes\nThe mill is old. It turns slowly.\nImprint · Terms", page) == "end"
    assert page_end.relation("Notes\nThe mill is old. It turns slowly.", page) == "block"
    assert page_end.relation("Notes\nThe mill is old. It tur", page) == "within"
    assert page_end.relation("Notes\nThe mill is old. It tur...", page) == "within"
    torn = page[: page.index(b"slow") + 2]
    assert page_end.relation("Notes\nThe mill is old. It turns sl", torn) == "torn"
    assert page_end.relation("Something that is not there", page) == "lost"
    assert page_end.relation("Any", None) == "none" == page_end.relation("Any", b"")
    wrong = "Müller öffnet die Brücke".encode("cp1252").decode("koi8_r")
    assert page_end.relation(wrong, "<p>Müller öffnet die Brücke</p>".encode("cp1252")) == "end"


def test_held_out_cuts(spark):
    """Cuts of documents of another table, made in another way: every place within a sentence is as likely."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    limits = truncated._table(truncated.length_limits(docs))
    w = truncated.fitted(docs, limits)
    rnd, right, made = random.Random(5), 0, 0
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) > 100").collect():
        if not truncated.intact(r.text, r.body):
            continue
        right += w[page_end.features(r.text, r.body, r.headers, r.source, limits)].sum() < 0
        made += 1
        places = truncated._places(r.text)
        if places:
            part = r.text[: rnd.choice(places)]
            right += w[page_end.features(part, r.body if rnd.random() < 0.5 else None, r.headers, r.source, limits)].sum() > 0
            made += 1
    assert made > 100 and right / made > 0.95


def test_empty_and_odd_tables(spark):
    kind = "doc_id long, source string, text string, body binary, headers string, score string, n int"
    rows = [(1, None, None, None, None, "x", 1), (2, "s", "", b"", "", "x", 1), (3, "s", " \n ", None, None, "x", 1), (None, "s", "a", b"\xff\xfe<", "content-length: x", "x", 1)]
    docs = spark.createDataFrame(rows, kind)
    assert truncated.truncated(docs).count() == 0
    assert truncated.truncated(docs.limit(0)).count() == 0
    assert {r.source: r.documents for r in truncated.shares(docs).collect()} == {None: 1, "s": 3}
