"""Messages delivered more than once: keep exactly one copy of each.

Only an identifier, the delivery order and the row's place in its file are shuffled. The winners become one vector of
bits per file, kept in the shared folder. Reading the payload, each task loads the vectors of the files that it reads,
and of each row only the file and the place go through the test, so the payload is neither shuffled nor sent anywhere,
whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import message_columns
from tidemark.session import shared_path, ship

#: Rows of a file covered by one bitmap (fixed by bitmap_construct_agg).
BLOCK = 32768
#: Vectors that a Python worker keeps at a time; a task reads few files.
LOADED = 16


def _placed(df: DataFrame) -> DataFrame:
    """df, which must be a plain file scan, with each row's place: file and row number."""
    return df.select("*", F.xxhash64(F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__row"))


@lru_cache(maxsize=LOADED)
def _vector(path: str, file: int) -> np.ndarray:
    """The bits of one file, True for the kept rows; rows beyond its end are not kept."""
    import pyarrow.fs
    import pyarrow.parquet as pq

    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    folder = f"{root}/__file={file}"
    if fs.get_file_info(folder).type == pyarrow.fs.FileType.NotFound:
        return np.zeros(0, bool)
    found = pq.read_table(folder, filesystem=fs, partitioning=None, columns=["__block", "__bits"])
    blocks = found["__block"].to_numpy()
    bits = np.zeros((int(blocks.max()) + 1, BLOCK // 8), np.uint8)
    for b, data in zip(blocks, found["__bits"]):
        bits[b] = np.frombuffer(data.as_py(), np.uint8)
    return np.unpackbits(bits.reshape(-1), bitorder="little").astype(bool)


def _kept(path: str):
    @F.pandas_udf("boolean")
    def kept(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for file, row in parts:
            f, r = file.to_numpy(), row.to_numpy()
            out = np.zeros(len(f), bool)
            for one in np.unique(f):
                mine = f == one
                vector, at = _vector(path, int(one)), r[mine]
                inside = at < len(vector)
                hit = np.zeros(len(at), bool)
                hit[inside] = vector[at[inside]]
                out[mine] = hit
            yield pd.Series(out)

    return kept


@dataclass
class KeepVectors:
    """The vectors at path, one folder for each file: a set bit marks a kept row, every other row of the file is deleted."""

    path: str

    def read(self, scan: DataFrame, deleted: bool = False) -> DataFrame:
        """The kept (or the deleted) rows of scan, the table the vectors were made from, with all its columns."""
        ship(scan.sparkSession)
        placed = _placed(scan)
        kept = _kept(self.path)(placed["__file"], placed["__row"])
        return placed.filter(~kept if deleted else kept).select(scan.columns)


def keep_vectors(scan: DataFrame, identity: dict[str, Column], order: Column) -> KeepVectors:
    """Select the row with the smallest order for each identity. This runs a job and writes the vectors.

    scan must be a plain file scan. The identifier that is shuffled is the long columns of identity as they
    are, and two independent 64-bit hashes of the others. The minimum is taken before the shuffle as well, so a
    message with very many copies costs each task one row. Equal orders: exactly one of the rows is kept. A
    null order loses to every other. Null identity columns are equal to each other; an empty table gives an
    empty result.
    """
    names = dict(identity)
    exact = [c.alias(f"__e{i}") for i, (n, c) in enumerate(names.items()) if n == "lsn"]
    hashed = [c for n, c in names.items() if n != "lsn"]
    marked = [F.concat_ws("", F.when(c.isNull(), F.lit("n")).otherwise(F.lit("v")), c.cast("string")) for c in hashed] or [F.lit("")]
    slim = _placed(scan).select(
        *exact,
        F.xxhash64(*marked).alias("__h1"),
        F.xxhash64(F.lit(0x9E3779B97F4A7C15 - (1 << 64)), *marked).alias("__h2"),
        F.coalesce(order.cast("long"), F.lit((1 << 63) - 1)).alias("__order"),
        "__file",
        "__row",
    )
    keys = [c for c in slim.columns if c[:3] in ("__e", "__h")]
    winners = slim.groupBy(*keys).agg(F.min(F.struct("__order", "__file", "__row")).alias("__w")).select("__w.*")
    bits = (
        winners.select("__file", F.floor(F.col("__row") / BLOCK).cast("long").alias("__block"), (F.col("__row") % BLOCK).alias("__bit"))
        .groupBy("__file", "__block")
        .agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    )
    path = shared_path(scan.sparkSession, "keep-vectors")
    # the blocks of one file go to one task: a file has one small vector file, not one for each task
    bits.repartition("__file").write.partitionBy("__file").parquet(path)
    return KeepVectors(path)


def message_vectors(changes: DataFrame) -> KeepVectors:
    """Keep the copy of each message that arrived first (smallest seq)."""
    return keep_vectors(changes, message_columns(changes), changes["seq"])


def deduplicated(changes: DataFrame) -> DataFrame:
    """changes, a plain file scan, with one row for each message and every column of the input."""
    return message_vectors(changes).read(changes)


def surplus(changes: DataFrame) -> DataFrame:
    """(seq) of every row that is not the kept copy of its message."""
    return message_vectors(changes).read(changes.select("seq"), deleted=True)
