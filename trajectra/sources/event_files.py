"""Metric records as event files: framed, checked records that dashboards follow, written and read as a Spark data source."""

from __future__ import annotations

import contextlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "step long, tag string, value float, wall_time double"
#: The polynomial of CRC-32C, what masks a checksum, the version of the first record, and the end of a file's name.
POLYNOMIAL, MASK, VERSION, PREFIX = 0x82F63B78, 0xA282EAD8, "brain.Event:2", "events.out.tfevents"


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (POLYNOMIAL if x & 1 else 0)
        out.append(x)
    return out


_TABLE = _crc_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c >> 8) ^ _TABLE[(c ^ b) & 255]
    return c ^ 0xFFFFFFFF


def masked(data: bytes) -> int:
    c = crc32c(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    """Length, its checksum, the data, its checksum."""
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked(size)) + data + struct.pack("<I", masked(data))


def unframed(data: bytes, name: str = "") -> Iterator[bytes]:
    """The records of a file; ValueError where one is cut short or its checksum is wrong."""
    at = 0
    while at < len(data):
        head = data[at : at + 12]
        if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked(head[:8]):
            raise ValueError(f"{name}: no record at {at}")
        end = at + 12 + struct.unpack("<Q", head[:8])[0]
        body, check = data[at + 12 : end], data[end : end + 4]
        if len(check) < 4 or struct.unpack("<I", check)[0] != masked(body):
            raise ValueError(f"{name}: a damaged record at {at}")
        yield body
        at = end + 4


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _block(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def scalar_event(wall_time: float, step: int, tag: str, value: float) -> bytes:
    """Fields: 1 time, 2 step, 5 a summary of one value, that is 1 tag and 2 number."""
    one = _block(1, tag.encode()) + b"\x15" + struct.pack("<f", value)
    return b"\x09" + struct.pack("<d", wall_time) + b"\x10" + _varint(step) + _block(5, _block(1, one))


def version_event(wall_time: float) -> bytes:
    return b"\x09" + struct.pack("<d", wall_time) + _block(3, VERSION.encode())


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            b = data[at]
            at += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield key >> 3, data[at : at + size]
        at += size


def scalars(record: bytes) -> Iterator[tuple[int, str, float, float]]:
    """(step, tag, value, wall time) of each number of a record; other records have none."""
    when, step, summaries = 0.0, 0, []
    for field, x in _fields(record):
        if field == 1:
            when = struct.unpack("<d", x)[0]
        elif field == 2:
            step = x - (1 << 64) if x >> 63 else x
        elif field == 5:
            summaries.append(x)
    for summary in summaries:
        for field, one in _fields(summary):
            if field == 1:
                parts = dict(_fields(one))
                if isinstance(parts.get(2), bytes):
                    yield step, bytes(parts.get(1, b"")).decode(), struct.unpack("<f", parts[2])[0], when


def _place(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


@dataclass
class Wrote(WriterCommitMessage):
    name: str | None


@dataclass
class File(InputPartition):
    name: str


class _Writer(DataSourceWriter):
    """Each task writes a hidden file of its own, commit gives those of the tasks that count their name; what others left is removed,
    and where a task that is being ended still holds it, stays hidden: readers take no file without the name."""

    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Wrote:
        from pyspark import TaskContext

        at, top = _place(self.path)
        out, name = None, None
        for r in iterator:
            if out is None:
                name = f"{self.run}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
                at.create_dir(f"{top}/_{self.run}", recursive=True)
                out = at.open_output_stream(f"{top}/_{self.run}/{name}")
                out.write(frame(version_event(r["wall_time"] or 0.0)))
            if r["step"] is not None and r["tag"] is not None and r["value"] is not None:
                out.write(frame(scalar_event(r["wall_time"] or 0.0, r["step"], r["tag"], r["value"])))
        if out is not None:
            out.close()
        return Wrote(name)

    def commit(self, messages: list[Wrote | None]) -> None:
        at, top = _place(self.path)
        at.create_dir(top, recursive=True)
        for m in messages:
            if m and m.name:
                at.move(f"{top}/_{self.run}/{m.name}", f"{top}/{PREFIX}.{m.name}")
        self._clear(at, top)

    def abort(self, messages: list[Wrote | None]) -> None:
        self._clear(*_place(self.path))

    def _clear(self, at, top: str) -> None:
        from pyarrow import fs

        if at.get_file_info(f"{top}/_{self.run}").type == fs.FileType.Directory:
            with contextlib.suppress(OSError):
                at.delete_dir(f"{top}/_{self.run}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        from pyarrow import fs

        at, top = _place(self.path)
        found = at.get_file_info(fs.FileSelector(top, allow_not_found=True))
        return [File(f.path) for f in found if f.type == fs.FileType.File and f.base_name.startswith(PREFIX)] or [File("")]

    def read(self, partition: File) -> Iterator[tuple]:
        if partition.name:
            at, _ = _place(self.path)
            with at.open_input_stream(partition.name) as f:
                for record in unframed(f.read(), partition.name):
                    yield from scalars(record)


class EventFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("event files are appended to")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventFiles)


def write_events(records: DataFrame, path: str, step: str = "step", wall_time: float = 0.0) -> None:
    """A record a row: its number columns become tags (their names), at its step. Nulls are left out; numbers are of 32 bits. One file a
    task that has rows; a task that fails leaves no file that counts."""
    register(records.sparkSession)
    tags = [f.name for f in records.schema if f.name != step and f.dataType.typeName() not in ("string", "binary", "array", "map", "struct")]
    each = [F.struct(F.lit(t).alias("tag"), F.col(f"`{t}`").cast("float").alias("value")) for t in tags]
    flat = records.select(F.col(f"`{step}`").cast("long").alias("step"), F.explode(F.array(*each)).alias("x"))
    flat.select("step", "x.tag", "x.value", F.lit(wall_time).alias("wall_time")).write.format("event_files").mode("append").save(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("event_files").load(path)
