"""Texts as ids of the public byte-level BPE vocabulary byte_bpe_50k, without special tokens, and back.

Rows are encoded in Arrow batches: no shuffle, and nothing depends on other rows. A batch's texts are taken as one
array of code points; pretokens.boundaries cuts it, and each slice of bytes is merged pair by pair, once for each distinct
slice that a worker keeps in its cache. The slices' places stay known, so that every id has its byte offset in the text.
Strings that look like special tokens are ordinary text.

Empty and null texts have an empty list of ids, and decode to an empty text. Texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.pretokens import boundaries
from tidemark.session import ship

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct slices a worker remembers, and the longest one that it does; only a matter of speed.
CACHED, CACHED_BYTES = 1 << 19, 48
#: Bytes of text cut at a time, whole texts, at least one.
BLOCK_BYTES = 4 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Byte-pair merging of slices by a vocabulary's ranks."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.widths = np.array([len(self.tokens.get(i, b"")) for i in range(max(self.tokens) + 1)])
        self._reset()

    def _reset(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pool: list[int] = []
        self.starts: list[int] = []
        self.sizes: list[int] = []

    def merged(self, part: bytes) -> list[int]:
        """The ids of one slice: the adjacent pair of lowest rank is merged, leftmost first, until none is left."""
        whole = self.ranks.get(part)
        if whole is not None:
            return [whole]
        n = len(part)
        ends = list(range(1, n + 1))  # end of the piece that begins here
        after = list(range(1, n + 1))
        prior = list(range(-1, n - 1))
        alive = bytearray(b"\x01" * n)
        ranks = self.ranks

        def pair(i: int) -> None:
            j = after[i]
            if j < n and (rank := ranks.get(part[i : ends[j]])) is not None:
                heapq.heappush(heap, (rank, i, ends[j]))

        heap: list[tuple[int, int, int]] = []
        for i in range(n - 1):
            pair(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ends[j] != end:
                continue  # one of the two has been merged since
            ends[i], after[i], alive[j] = end, after[j], 0
            if after[i] < n:
                prior[after[i]] = i
            pair(i)
            if prior[i] >= 0:
                pair(prior[i])
        return [ranks[part[i : ends[i]]] for i in range(n) if alive[i]]

    def _code(self, part: bytes) -> int:
        code = len(self.starts)
        ids = self.merged(part)
        self.starts.append(len(self.pool))
        self.sizes.append(len(ids))
        self.pool += ids
        if len(part) <= CACHED_BYTES:
            self.known[part] = code
        return code

    def encode(self, data: bytes, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each slice) of the slices of data that begin at cuts."""
        if len(self.known) > CACHED:
            self._reset()
        at = cuts.tolist()
        known, code = self.known, self._code
        parts = [data[a:b] for a, b in zip(at, [*at[1:], len(data)])]
        codes = np.array([known[p] if p in known else code(p) for p in parts], np.int64)
        size = np.array(self.sizes, np.int64)[codes]
        start = np.array(self.starts, np.int64)[codes]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        place = np.arange(total) + np.repeat(start - (upto - size), size)
        ids = np.array(self.pool, np.int32)[place] if total else np.zeros(0, np.int32)
        if len(self.starts) > 2 * CACHED:
            self._reset()
        return ids, size

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """Loaded once in each Python worker."""
    return Encoder(path)


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BLOCK_BYTES each."""
    begin, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > BLOCK_BYTES:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def encode_column(texts: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, number of ids of each row, byte offset of each id in its text) of consecutive rows of a string column."""
    if not len(texts):
        return
    enc = encoder(path)
    texts = texts.cast(pa.large_string()).fill_null("")
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    for a, b in _blocks(np.diff(ends)):
        block = raw[ends[a] : ends[b]]
        data = block.tobytes()
        text = data.decode("utf-8", "surrogateescape")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        lead = np.flatnonzero((block & 0xC0) != 0x80)
        if len(lead) != len(points):  # bytes that are no UTF-8: each stands for itself
            width = np.array([len(c.encode("utf-8", "surrogateescape")) for c in text])
            lead = np.cumsum(width) - width
        begin = ends[a:b] - ends[a]
        filled = begin[np.diff(ends[a : b + 1]) > 0]
        first = np.zeros(len(points), bool)
        first[np.searchsorted(lead, filled)] = True
        cuts = lead[boundaries(points, first)]
        ids, size = enc.encode(data, cuts)
        upto = np.concatenate([[0], np.cumsum(size)])
        row_ids = np.diff(upto[np.searchsorted(cuts, np.append(begin, len(data)))])
        width = enc.widths[ids]
        yield b - a, ids, row_ids, (np.cumsum(width) - width - np.repeat(begin, row_ids)).astype(np.int32)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def token_ids(documents: DataFrame, path: str | None = None, offsets: bool = False) -> DataFrame:
    """(doc_id, ids), with offsets as well where asked: one row for each row of documents; [] for empty and null text.

    offsets holds the place of each id's first byte in the UTF-8 text. Other columns of documents play no part.
    """
    ship(documents.sparkSession)
    path = path or vocabulary_path()
    names = ["doc_id", "ids", "offsets"][: 2 + offsets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for rows, ids, sizes, at in encode_column(batch.column(1), path):
                columns = [batch.column(0).slice(done, rows), _lists(ids, sizes), _lists(at, sizes)]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names)
                done += rows

    kinds = ", ".join(f"{n} {'long' if n == 'doc_id' else 'array<int>'}" for n in names)
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)


def token_counts(documents: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns keep of documents and n_tokens, the length of token_ids; one row for each row of documents."""
    ship(documents.sparkSession)
    path = path or vocabulary_path()
    slim = documents.select(*keep, F.col("text").cast("string").alias("__text"))
    kind = slim.select(*keep, F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [s for _, _, s, _ in encode_column(batch.column(len(keep)), path)]
            count = pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), count], [*keep, "n_tokens"])

    return slim.mapInArrow(run, kind)


def decoded(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the exact inverse of token_ids, null ids as empty ones."""
    ship(encoded.sparkSession)
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(path).decode
        for batch in batches:
            texts = [decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
