"""Messages of the public logical replication protocol, version 1: bytes to rows, rows to change events, and back to bytes.

Decoding is in two steps. parse() turns each frame into a row by itself, in Arrow batches, so any number of tasks share
the work. changes() then binds row messages to the relation that was sent last before them and to their
transaction, both found as of their place in the stream by range partitions, not by one task that remembers.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.envelope import image, key_names
from tidemark.operators.ordering import as_of, running
from tidemark.session import ship, written

_CELLS = "array<struct<code string, text string>>"
PARSED = (
    "seq long, wal_start long, lsn long, kind string, relation_id long, namespace string, name string, columns array<struct<flags int, name string>>, "
    f"before {_CELLS}, after {_CELLS}, xid long, end_lsn long, error string"
)
#: Message tags with an effect (fixed values of the protocol), and those that are only counted.
TAGS = {"R": "relation", "B": "begin", "C": "commit", "I": "insert", "U": "update", "D": "delete"}
IGNORED = {"T": "truncate", "Y": "type", "O": "origin", "M": "message"}


class _Bytes:
    """A message read from its start; reading beyond its end raises."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the message ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(f">{form}", self.take(struct.calcsize(form)))[0]

    def text(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise ValueError("a name has no end")
        out = self.data[self.at : end].decode("utf-8", "replace")
        self.at = end + 1
        return out

    def cells(self) -> list[dict]:
        out = []
        for _ in range(self.number("h")):
            code = chr(self.number("B"))
            text = self.take(self.number("i")).decode("utf-8", "replace") if code in "tb" else None
            out.append({"code": code, "text": text})
        return out


def parse_message(payload: bytes) -> dict:
    """One message as a dict of PARSED's fields; kind error with the reason if it cannot be read."""
    try:
        b = _Bytes(payload)
        tag = chr(b.number("B"))
        if tag in IGNORED:
            return {"kind": "ignored", "name": IGNORED[tag]}
        if tag not in TAGS:
            raise ValueError(f"unknown tag {tag!r}")
        out: dict = {"kind": TAGS[tag]}
        if tag == "B":
            out["end_lsn"], _, out["xid"] = b.number("q"), b.number("q"), b.number("i")
        elif tag == "C":
            b.number("B")
            b.number("q")
            out["end_lsn"] = b.number("q")
        elif tag == "R":
            out |= {"relation_id": b.number("I"), "namespace": b.text(), "name": b.text()}
            b.number("B")
            columns = []
            for _ in range(b.number("h")):
                flags, name = b.number("B"), b.text()
                b.take(8)
                columns.append({"flags": flags, "name": name})
            out["columns"] = columns
        else:
            out["relation_id"] = b.number("I")
            part = chr(b.number("B"))
            if part in "KO":
                out["before"] = b.cells()
                part = chr(b.number("B")) if tag == "U" else ""
            if tag != "D":
                if part != "N":
                    raise ValueError("no new row")
                out["after"] = b.cells()
        return out
    except (ValueError, struct.error) as e:
        return {"kind": "error", "error": str(e)[:200]}


def demux(frame: bytes) -> dict:
    """A frame of the replication stream: data with its place, or a keepalive; error for anything else."""
    try:
        b = _Bytes(frame)
        tag = chr(b.number("B"))
        if tag == "w":
            start, _, _ = b.number("q"), b.number("q"), b.number("q")
            return {"type": "data", "wal_start": start, "payload": frame[b.at :]}
        if tag == "k":
            end, _, reply = b.number("q"), b.number("q"), b.number("B")
            return {"type": "keepalive", "wal_start": end, "reply": bool(reply)}
        raise ValueError(f"unknown frame {tag!r}")
    except (ValueError, struct.error) as e:
        return {"type": "error", "error": str(e)[:200]}


def keepalive_reply(durable_lsn: int, clock_micros: int) -> bytes:
    """A status update that acknowledges what is durable, never the server's own end."""
    return struct.pack(">BqqqqB", ord("r"), durable_lsn, durable_lsn, durable_lsn, clock_micros, 0)


def parse(frames: DataFrame) -> DataFrame:
    """PARSED rows of (seq, frame): keepalives are left out, unreadable frames and messages are of kind error.

    lsn is the message's start plus its length. Null frames count as unreadable.
    """
    ship(frames.sparkSession)
    names = [c.split()[0] for c in ("seq", "wal_start", "lsn", "kind", "relation_id", "namespace", "name", "columns", "before", "after", "xid", "end_lsn", "error")]
    cells = pa.list_(pa.struct([("code", pa.string()), ("text", pa.string())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("flags", pa.int32()), ("name", pa.string())])), cells, cells, pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for seq, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = demux(frame or b"")
                if f["type"] == "data":
                    rows.append({"seq": seq, "wal_start": f["wal_start"], "lsn": f["wal_start"] + len(f["payload"]), **parse_message(f["payload"])})
                elif f["type"] == "error":
                    rows.append({"seq": seq, "kind": "error", "error": f["error"]})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds)], names)

    return frames.select("seq", "frame").mapInArrow(run, PARSED)


def counts(parsed: DataFrame) -> DataFrame:
    """(kind, name, n): messages by kind, ignored ones by name as well; errors are the dead letters."""
    return parsed.groupBy("kind", F.when(F.col("kind") == "ignored", F.col("name")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.filter("kind = 'error'").select("seq", "wal_start", "error")


def changes(parsed: DataFrame, source_type: str = "postgres") -> DataFrame:
    """Change events of one stream: seq, txn_id, commit_lsn, source_type, action, schema_name, table_name, key_names, images, lsn.

    Rows of relations that were not announced before them are dropped. The last row of each transaction has the commit's
    end as its lsn; a transaction without rows gives one COMMIT row.
    """
    parsed = written(parsed, "parsed")  # decoded once, read for rows, transactions and relations
    rows = parsed.filter(F.col("kind").isin("insert", "update", "delete", "begin", "commit"))
    # a transaction is what lies between its begin and the next
    begun = running(rows, [], ["seq"], {"txn_id": ("last", F.when(F.col("kind") == "begin", F.col("xid")))}).withColumn("__one", F.lit(1))
    ends = begun.filter("kind = 'commit'").groupBy("txn_id").agg(F.max("end_lsn").alias("commit_lsn"), F.max("seq").alias("__at"))
    facts = parsed.filter("kind = 'relation'").select("relation_id", "seq", F.col("namespace").alias("schema_name"), F.col("name").alias("table_name"), "columns")
    events = begun.filter(F.col("kind").isin("insert", "update", "delete")).select("seq", "lsn", "kind", "relation_id", "before", "after", "txn_id")
    bound = as_of(events, facts, ["relation_id"], "seq", ["schema_name", "table_name", "columns"], "known").filter("known")
    last = bound.groupBy("txn_id").agg(F.max("seq").alias("__last"))
    bound = bound.join(ends.drop("__at"), "txn_id", "left").join(last, "txn_id", "left")
    empty = F.lit(None).cast("map<string,string>")
    out = bound.select(
        "seq", "txn_id", "commit_lsn", F.lit(source_type).alias("source_type"), F.upper("kind").alias("action"), "schema_name", "table_name",
        key_names(F.col("columns")).alias("key_names"), image(F.col("columns"), F.col("before")).alias("before_image"), image(F.col("columns"), F.col("after")).alias("after_image"),
        F.when((F.col("seq") == F.col("__last")) & F.col("commit_lsn").isNotNull(), F.col("commit_lsn")).otherwise(F.col("lsn")).alias("lsn"),
    )
    markers = ends.join(last, "txn_id", "left_anti").select(
        F.col("__at").alias("seq"), "txn_id", "commit_lsn", F.lit(source_type).alias("source_type"), F.lit("COMMIT").alias("action"), F.lit("").alias("schema_name"), F.lit("").alias("table_name"),
        F.array().cast("array<string>").alias("key_names"), empty.alias("before_image"), empty.alias("after_image"), F.col("commit_lsn").alias("lsn"),
    )
    return out.unionByName(markers)


# the other direction: for tests and for files of frames -------------------------------------------------------------


def _name(text: str) -> bytes:
    return text.encode() + b"\0"


def tuple_bytes(columns: list[str], row: dict | None) -> bytes:
    """A row by its columns: n for null, u for a column that is not in row."""
    out = struct.pack(">h", len(columns))
    for c in columns:
        if row is None or c not in row:
            out += b"u"
        elif row[c] is None:
            out += b"n"
        else:
            data = row[c].encode()
            out += b"t" + struct.pack(">i", len(data)) + data
    return out


def relation_bytes(relation_id: int, namespace: str, name: str, columns: list[tuple[str, int]]) -> bytes:
    body = b"".join(struct.pack(">B", flags) + _name(c) + struct.pack(">ii", 25, -1) for c, flags in columns)
    return b"R" + struct.pack(">I", relation_id) + _name(namespace) + _name(name) + b"d" + struct.pack(">h", len(columns)) + body


def begin_bytes(end_lsn: int, xid: int) -> bytes:
    return b"B" + struct.pack(">qqi", end_lsn, 0, xid)


def commit_bytes(lsn: int, end_lsn: int) -> bytes:
    return b"C" + struct.pack(">Bqqq", 0, lsn, end_lsn, 0)


def row_bytes(action: str, relation_id: int, columns: list[str], before: dict | None, after: dict | None) -> bytes:
    out = action[0].encode() + struct.pack(">I", relation_id)
    if before is not None:
        out += b"O" + tuple_bytes(columns, before)
    elif action == "DELETE":
        out += b"K" + tuple_bytes(columns, {})
    return out + (b"N" + tuple_bytes(columns, after) if action != "DELETE" else b"")


def frame_bytes(wal_start: int, payload: bytes) -> bytes:
    return b"w" + struct.pack(">qqq", wal_start, wal_start + len(payload), 0) + payload


def keepalive_bytes(end_lsn: int, reply: bool) -> bytes:
    return b"k" + struct.pack(">qqB", end_lsn, 0, int(reply))


def source_options(url: str) -> tuple[str, dict[str, str]]:
    """(connection string without them, options): slot_name and publication_names are taken out of the query and required."""
    from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

    parts = urlsplit(url)
    query = dict(parse_qsl(parts.query))
    taken = {k: query.pop(k) for k in ("slot_name", "publication_names") if query.get(k)}
    if missing := [k for k in ("slot_name", "publication_names") if k not in taken]:
        raise ValueError(f"the source needs {' and '.join(missing)}")
    return urlunsplit(parts._replace(query=urlencode(query))), taken


def slot_ready(create, name: str) -> bool:
    """Create a replication slot by create(name); that it already exists is as good. True if it is new."""
    try:
        create(name)
        return True
    except Exception as e:
        if "already exists" in str(e):
            return False
        raise


def checkpoint_json(lsn: int) -> str:
    return json.dumps({"lsn": str(lsn)})
