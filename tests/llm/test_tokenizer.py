import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tidemark.llm import tokenizer
from tidemark.llm.pretokens import automaton, boundaries

SF = "/root/testdata/sf0.001"
OTHER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
OTHER.encode_special_tokens = True


def other(text):
    return OTHER.encode(text, add_special_tokens=False).ids if text else []


def encoded(texts):
    out = []
    for rows, ids, sizes, at in tokenizer.encode_column(pa.array(texts, pa.string()), tokenizer.vocabulary_path()):
        upto = np.concatenate([[0], np.cumsum(sizes)])
        out += [(ids[a:b].tolist(), at[a:b].tolist()) for a, b in zip(upto[:-1], upto[1:])]
    return out


def test_p6_ids_against_the_other_library(spark):
    got = {r.doc_id: list(r.ids) for r in entry.queries()["p6_ids"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == other(r.text)


def test_p6_decoded_is_the_text(spark):
    got = {r.doc_id: r.text for r in entry.queries()["p6_decoded"](spark, SF).collect()}
    want = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert got == want


def test_random_texts_and_offsets():
    rnd = random.Random(1)
    parts = ["'", "''", "s", "re", "ve", "ll", "'d", "'t", " ", "  ", "\n", "\t", "a", "B", "é", "1", "２", "!", "。", "語", "\u0085", "\x1c", "😀"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(4000)]
    texts += [None, "", "<|endoftext|>", "a" * 5000, " " * 3000 + "x", "'" * 999, "ab" * 3000]
    vocabulary = tokenizer.encoder(tokenizer.vocabulary_path())
    for text, (ids, at) in zip(texts, encoded(texts), strict=True):
        assert ids == other(text), repr(text)[:200]
        raw = (text or "").encode()
        assert vocabulary.decode(ids) == raw
        assert all(raw[o : o + len(vocabulary.tokens[i])] == vocabulary.tokens[i] for i, o in zip(ids, at))


def test_composition_is_associative_and_closed():
    _, compose, *_ = automaton()
    n = len(compose)
    for a in range(n):
        for b in range(n):
            assert (compose[compose[a, b]] == compose[a, compose[b]]).all()


def test_texts_of_one_block_do_not_touch():
    texts = ["it'", "s", " ", "x", "", "\n", "\n", "a"]
    points = np.array([ord(c) for t in texts for c in t], np.uint32)
    first = np.array([i == 0 for t in texts for i in range(len(t))])
    starts = set(boundaries(points, first).tolist())
    assert set(np.flatnonzero(first).tolist()) <= starts
    assert [i for i, _ in encoded(texts)] == [other(t) for t in texts]


def test_empty_table_extra_columns_and_counts(spark):
    kind = "doc_id long, ids string, source string, n_tokens string, text string"
    rows = [(1, "z", "a", "q", ""), (2, "z", "a", "q", None), (3, None, None, None, "<|endoftext|>"), (3, "z", "a", "q", "  \n é"), (None, None, None, None, "x")]
    docs = spark.createDataFrame(rows, kind)
    got = sorted((r.doc_id or 0, list(r.ids)) for r in tokenizer.token_ids(docs).collect())
    assert got == sorted((r[0] or 0, other(r[4])) for r in rows)
    counts = tokenizer.token_counts(docs.drop("n_tokens"), ["doc_id", "source"])
    assert sorted(r.n_tokens for r in counts.collect()) == sorted(len(i) for _, i in got)
    assert tokenizer.token_ids(docs.limit(0)).count() == 0
