"""Texts that stop before their page does, in mid-word or mid-sentence.

Positives are made from the documents themselves: texts known to be intact are cut at arbitrary places and at the limits
that their source shows, with and without a mark, with the page kept, cut at the same place, or missing. A logistic
regression on hashed features of the closing signs, the punctuation, the distance to the limit and the page is fitted on
them and on the intact texts, and scores every document. Headings, lists, verses and footers are among the intact texts,
so that it learns that they do without a full stop.

Limits are lengths at which far more texts of a source end than at those around; they are counted over all documents.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.page_end import DIMENSIONS, TERMINAL, features, relation, without_mark
from tidemark.session import ship, written

#: Documents that the fit is made on; more or less, as they are drawn by a hash of doc_id.
SAMPLE = 4000
#: Tasks that make the examples; their number is bounded, as the sample is.
FIT_TASKS = 12
#: Steps of the fit.
ROUNDS = 400
#: A length is a limit if LEAST more texts have it than the mean of the lengths within AROUND of it, and PEAK deviations more.
LEAST, PEAK, AROUND = 4, 6.0, 60
#: Of each source and kind of length the most frequent limits count.
LIMITS = 8
_NOT_LAST = TERMINAL + " \t\r\n\u3000"
_MARKS = ["", "", "", "", "", "", "...", "…"]
_STOP = re.compile(rf"[{re.escape(TERMINAL)}]")


def length_limits(documents: DataFrame) -> DataFrame:
    """(source, kind, n, texts): the limits of each source, in characters and in bytes. Null sources are one source."""
    t = documents.filter(F.length("text") > 0).select("source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    each = t.select("source", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("kind", "n"))
    counted = written(each.groupBy("source", "kind", "n").agg(F.count(F.lit(1)).alias("texts")), "lengths")
    around = Window.partitionBy("source", "kind").orderBy("n").rangeBetween(-AROUND, AROUND)
    near = counted.withColumn("mean", (F.sum("texts").over(around) - F.col("texts")) / F.lit(2.0 * AROUND))
    peaks = near.filter((F.col("texts") >= F.col("mean") + PEAK * F.sqrt("mean") + LEAST) & (F.col("n") >= 100))
    first = F.row_number().over(Window.partitionBy("source", "kind").orderBy(F.desc("texts"), "n"))
    return peaks.withColumn("__r", first).filter(F.col("__r") <= LIMITS).select("source", "kind", "n", "texts")


def _table(limits: DataFrame) -> dict:
    """The limits for look-up; at most LIMITS for each source and kind."""
    out: dict = {}
    for r in limits.collect():
        out.setdefault((r.source, r.kind), []).append(r.n)
    return out


def _places(text: str) -> list[int]:
    """Where a cut would be in mid-word or mid-sentence: not after a stop, and the line goes on to one."""
    out = []
    for m in re.finditer(r"[^\n]+", text):
        line = m[0]
        stops = [s.start() for s in _STOP.finditer(line)]
        if stops and len(line) >= 12:
            last = stops[-1]
            out += [m.start() + i for i in range(5, last) if line[i - 1] not in _NOT_LAST and line[i] not in TERMINAL]
    return out


def _cut(text: str, limits: dict[str, list[int]], rnd: random.Random) -> str | None:
    """text cut somewhere within a sentence, half the time at a limit of its source if one is near enough."""
    places = _places(text)
    if not places:
        return None
    at = rnd.choice(places)
    if rnd.random() < 0.6:
        kind = rnd.choice(sorted(k for k, v in limits.items() if v) or ["none"])
        if kind == "bytes":  # a character may be cut in two
            short = text.encode("utf-8", "replace")[: rnd.choice(limits[kind])].decode("utf-8", "replace")
            if len(short) < len(text) and short[-1:] not in _NOT_LAST and "\n" not in text[len(short) - 1 : len(short) + 1]:
                return short
        elif kind == "chars":
            fit = [p for p in places if any(0 <= n - p <= 2 for n in limits[kind])]
            at = rnd.choice(fit) if fit else at
    return text[:at] + rnd.choice(_MARKS)


def intact(text: str, body: bytes | None) -> bool:
    """Whether a text is known not to stop in mid-sentence: it ends in a stop, or its page shows that its block ends there."""
    return without_mark(text)[0][-1:] in TERMINAL or relation(text, body) in ("end", "block")


def examples(text: str, body: bytes | None, headers: str | None, source: str | None, limits: dict, rnd: random.Random) -> list[tuple[int, list[int]]]:
    """(label, features) of an intact text as it is, with and without its page, and of cuts made from it; none of others."""
    if not intact(text, body):
        return []
    out = [(0, features(text, body, headers, source, limits))]
    if body:
        out.append((0, features(text, None, headers, source, limits)))
    for _ in range(2):
        part = _cut(text, {kind: limits.get((source, kind), []) for kind in ("chars", "bytes")}, rnd)
        if part is None:
            break
        page, how = body, rnd.random()
        if how < 0.4:
            page = None
        elif body and how < 0.7:  # the transfer broke off: the page stops there too, a character or a tag cut in two
            part = without_mark(part)[0].rstrip("\ufffd")
            tail = part[-12:].encode("utf-8", "replace")
            at = body.find(tail)
            if at >= 0:
                page, tag = body[: at + len(tail)], rnd.random() < 0.2
                page += b" <a hre" if tag else b""
                part += rnd.choice([" <a hre", "", ""]) if tag else rnd.choice(["", "", "", "\ufffd"])
        out.append((1, features(part, page, headers, source, limits)))
    return out


def _columns(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text", "body", "headers")


def _sample(documents: DataFrame, limits: dict) -> tuple[np.ndarray, np.ndarray]:
    """(feature indexes, labels) made on the executors from about SAMPLE documents; only these come to the driver."""
    total = documents.count()
    share = 1.0 if total <= SAMPLE else SAMPLE / total
    drawn = _columns(documents).filter(F.length("text") > 0)
    drawn = drawn.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(2 * SAMPLE)
    drawn = drawn.repartition(FIT_TASKS)  # a limit leaves one partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, source, text, body, headers in zip(*(c.to_pylist() for c in batch.columns)):
                rows += examples(text, body, headers, source, limits, random.Random(d or 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["label", "ix"])

    # in a fixed order, so that the sums of the fit come out alike however the rows were spread
    got = sorted((tuple(r.ix), r.label) for r in drawn.mapInArrow(run, "label int, ix array<int>").collect())
    return np.array([ix for ix, _ in got], np.int64), np.array([label for _, label in got], float)


def _fit(ix: np.ndarray, label: np.ndarray) -> np.ndarray:
    w, seen = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6)
    for _ in range(ROUNDS):
        err = 1 / (1 + np.exp(-w[ix].sum(1))) - label
        g = np.bincount(ix.ravel(), np.repeat(err, ix.shape[1]), DIMENSIONS) / len(label) + 1e-5 * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
    return w


def fitted(documents: DataFrame, limits: dict) -> np.ndarray:
    """The weights of the regression; zeros where there is nothing to learn from."""
    ix, label = _sample(documents, limits)
    if not label.any():
        return np.zeros(DIMENSIONS)
    return _fit(ix, label)


def scored(documents: DataFrame) -> DataFrame:
    """(doc_id, source, score) of every row of documents; empty, blank and null texts score 0. Fits the model first."""
    ship(documents.sparkSession)
    limits = _table(length_limits(documents))
    w = fitted(documents, limits)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, source, *rest = batch.columns
            s = [
                float(1 / (1 + np.exp(-w[features(text, body, headers, of, limits)].sum()))) if text and text.strip() else 0.0
                for of, text, body, headers in zip(source.to_pylist(), *(c.to_pylist() for c in rest))
            ]
            yield pa.RecordBatch.from_arrays([doc_id, source, pa.array(s, pa.float64())], ["doc_id", "source", "score"])

    return _columns(documents).mapInArrow(score, "doc_id long, source string, score double")


def truncated(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents whose text was cut. No texts, or none that a cut could be made from: no rows."""
    return scored(documents).filter("score > 0.5").select("doc_id")


def shares(documents: DataFrame) -> DataFrame:
    """(source, documents, cut, share), null source included."""
    of = scored(documents).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("score") > 0.5, 1)).alias("cut"))
    return of.withColumn("share", F.col("cut") / F.col("documents"))
