"""Files of frames as a streaming and batch source: spark.read.format("change_frames"), spark.readStream likewise.

A folder holds files named by the number of their first frame, <number>.frames, each a row of frames with a four-byte
length before each. Options: path; slot_name and publication_names, as the replication stream needs them; start, the
number of the first frame (default 0); max_frames, the most a micro-batch takes; ack, a file that gets the number of
frames that are done with, as replication feedback; throttle, a file during whose presence nothing new is taken in.

The live stream of a server is another reader with the same interface; it needs a driver and a server.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "seq long, frame binary"
MAX_FRAMES, PER_PARTITION = 50_000, 10_000


def write_frames(folder: str | Path, first: int, frames: list[bytes]) -> Path:
    """Write a file of frames as a whole."""
    p = Path(folder)
    p.mkdir(parents=True, exist_ok=True)
    part = p / f".{first:020d}.tmp"
    with part.open("wb") as f:
        for frame in frames:
            f.write(struct.pack(">I", len(frame)) + frame)
    done = p / f"{first:020d}.frames"
    os.replace(part, done)
    return done


def _files(folder: str) -> list[tuple[int, Path]]:
    return sorted((int(p.stem), p) for p in Path(folder).glob("*.frames"))


def _scan(path: Path) -> Iterator[bytes]:
    with path.open("rb") as f:
        while head := f.read(4):
            if len(head) < 4:
                return
            n = struct.unpack(">I", head)[0]
            frame = f.read(n)
            if len(frame) < n:
                return
            yield frame


def _count(path: Path) -> int:
    n, size, at = 0, path.stat().st_size, 0
    with path.open("rb") as f:
        while at + 4 <= size:
            f.seek(at)
            at += 4 + struct.unpack(">I", f.read(4))[0]
            n += at <= size
    return n


@dataclass
class FrameRange(InputPartition):
    first: int
    end: int


def _read(folder: str, first: int, end: int) -> Iterator[tuple[int, bytes]]:
    for number, path in _files(folder):
        if number >= end:
            return
        for i, frame in enumerate(_scan(path)):
            if first <= number + i < end:
                yield number + i, frame


def _end(folder: str) -> int:
    files = _files(folder)
    return files[-1][0] + _count(files[-1][1]) if files else 0


def _ranges(first: int, end: int) -> list[FrameRange]:
    return [FrameRange(a, min(a + PER_PARTITION, end)) for a in range(first, end, PER_PARTITION)]


def checked(options: dict) -> dict:
    if missing := [k for k in ("path", "slot_name", "publication_names") if not options.get(k)]:
        raise ValueError(f"change_frames needs the options {', '.join(missing)}")
    return options


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.start = options["path"], int(options.get("start", 0))

    def partitions(self) -> list[FrameRange]:
        return _ranges(self.start, _end(self.folder)) or [FrameRange(0, 0)]

    def read(self, partition: FrameRange) -> Iterator[tuple[int, bytes]]:
        return _read(self.folder, partition.first, partition.end)


class FrameStreamReader(DataSourceStreamReader):
    """Spark asks for the latest offset without telling the last one, so the reader keeps a cursor to limit a batch."""

    def __init__(self, options: dict):
        self.folder, self.start = options["path"], int(options.get("start", 0))
        self.most = int(options.get("max_frames", MAX_FRAMES))
        self.ack, self.throttle = options.get("ack"), options.get("throttle")
        self.cursor: int | None = None

    def initialOffset(self) -> dict:
        return {"frame": self.start}

    def latestOffset(self) -> dict:
        at = self.start if self.cursor is None else self.cursor
        if self.throttle and os.path.exists(self.throttle):
            return {"frame": at}
        self.cursor = min(max(_end(self.folder), at), at + self.most)
        return {"frame": self.cursor}

    def partitions(self, start: dict, end: dict) -> list[FrameRange]:
        self.cursor = max(self.cursor or 0, end["frame"])  # after a restart the planned batch comes first
        return _ranges(start["frame"], end["frame"])

    def read(self, partition: FrameRange) -> Iterator[tuple[int, bytes]]:
        return _read(self.folder, partition.first, partition.end)

    def commit(self, end: dict) -> None:
        if self.ack:
            part = f"{self.ack}.tmp"
            Path(part).write_text(json.dumps({"frame": end["frame"]}))
            os.replace(part, self.ack)


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "change_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(checked(dict(self.options)))

    def streamReader(self, schema) -> FrameStreamReader:
        return FrameStreamReader(checked(dict(self.options)))


def probe(folder: str) -> None:
    """Raises if the folder cannot be read; takes nothing from it."""
    if not os.path.isdir(folder):
        raise FileNotFoundError(folder)
    os.listdir(folder)
