"""WARC archives as a Spark data source: writer, reader with pushed-down filters, and deduplicated captures.

Reading: `read_warc(spark, path)` plans one partition per file, or per recorded stretch of a file that this
writer made; record types and header columns are compared after a record's headers are parsed and before its
block is decoded; the block of a record that isn't wanted, or of any record with payload=False, is passed over.
"""

from __future__ import annotations

import base64
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import attach, materialise, new_path

#: Payloads below this size are always written in full.
MIN_REVISIT_BYTES = 1000
#: Bytes of one stretch of a file that is read as a partition.
STRETCH = 16 << 20
_HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "page_id": "X-Page-ID",
    "refers_to_page": "X-Refers-To-Page-ID",
}
SCHEMA = ", ".join(f"{c} string" for c in _HEADERS) + ", payload_length long, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _fs(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", path)))
    return pafs.LocalFileSystem(), path


# ---- records


def _clean(value: object) -> bytes:
    return re.sub(r"[\r\n]+", lambda m: "%0D%0A", str(value)).encode()


def encode_record(row: dict, compress: bool) -> bytes:
    """One record. A revisit has the HTTP headers of the capture, with the full payload's length, and no payload."""
    payload = row["payload"] if row["record_type"] != "revisit" else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row["payload_length"]
    lines = [b"WARC/1.1"]
    for column, name in _HEADERS.items():
        if row.get(column) is not None:
            lines.append(name.encode() + b": " + _clean(row[column]))
    if row["record_type"] == "revisit":
        lines.append(b"WARC-Profile: " + _PROFILE.encode())
    lines += [b"Content-Type: application/http;msgtype=response", b"Content-Length: %d" % (len(http) + len(payload)), b"", b""]
    raw = b"\r\n".join(lines) + http + payload + b"\r\n\r\n"
    if not compress:
        return raw
    squeeze = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = squeeze.compress(raw) + squeeze.flush()
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    # The gzip member says in an extra field, 'sl', how long it is, so that a reader can step over it.
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(raw)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00" + b"\x00" * 5 + b"\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, size, len(raw))
    return b"\x1f\x8b\x08\x04" + b"\x00" * 5 + b"\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def _parse(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def _member(file, at: int) -> tuple[int | None, bytes]:
    """Length of the gzip member at a place, if it says so, and its first bytes."""
    file.seek(at)
    start = file.read(1 << 16)
    if len(start) > 24 and start[3] & 4 and start[12:14] == b"sl":
        return struct.unpack("<I", start[16:20])[0], start
    return None, start


def read_records(file, begin: int, end: int, zipped: bool, wanted, payload: bool) -> Iterator[dict]:
    """Records that begin in [begin, end): headers first; wanted(headers) decides if the block is looked at."""
    at = begin
    while at < end:
        if zipped:
            length, start = _member(file, at)
            inflate = zlib.decompressobj(31)
            raw, used = inflate.decompress(start, 0 if length is None else 1 << 15), len(start)
            while b"\r\n\r\n" not in raw and not inflate.eof:
                more = inflate.unconsumed_tail or file.read(1 << 16)
                if not more:
                    raise ValueError(f"a record at {at} has no end")
                used += 0 if inflate.unconsumed_tail else len(more)
                raw += inflate.decompress(more, 1 << 15)
        else:
            file.seek(at)
            raw = b""
            while b"\r\n\r\n" not in raw and (more := file.read(1 << 14)):
                raw += more
        cut = raw.find(b"\r\n\r\n")
        if cut < 0:
            if raw.strip():
                raise ValueError(f"a record at {at} has no header end")
            return
        head = _parse(raw[:cut])
        size = cut + 4 + int(head["content-length"])
        take = wanted(head)
        if zipped and (length is None or take and payload):
            while not inflate.eof:
                more = inflate.unconsumed_tail or file.read(1 << 20)
                if not more:
                    raise ValueError(f"a record at {at} has no end")
                used += 0 if inflate.unconsumed_tail else len(more)
                piece = inflate.decompress(more)
                if take:
                    raw += piece
            length = used - len(inflate.unused_data)
        elif not zipped:
            length = size + 4
            if take and payload and len(raw) < size:
                raw += file.read(size - len(raw))
        if take:
            yield head | {"": raw[cut + 4 : size]}
        at += length


# ---- the data source


@dataclass
class Stretch(InputPartition):
    file: str
    begin: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in _HEADERS and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)):
                self.tests.append((type(f).__name__, name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, top = _fs(self.path)
        names = {x.path: x.size for x in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if x.is_file}
        lists = [p for p in names if re.search(r"/_manifest-[^/]*\.json$", p)]
        if not lists:  # archives of other makers
            return [Stretch(p, 0, n) for p, n in sorted(names.items()) if re.search(r"\.warc(\.gz)?$", p)] or [Stretch("", 0, 0)]
        out = []
        for p in sorted(lists):
            with fs.open_input_stream(p) as f:
                for entry in json.loads(f.read()):
                    cuts = entry["cuts"]
                    out += [Stretch(f"{top}/{entry['name']}", a, b) for a, b in zip(cuts, cuts[1:])]
        return out or [Stretch("", 0, 0)]

    def _wanted(self, head: dict) -> bool:
        for kind, column, value in self.tests:
            got = _value(head, column)
            if got is None or kind == "EqualTo" and got != value or kind == "In" and got not in value or kind == "StringStartsWith" and not got.startswith(value):
                return False
        return True

    def read(self, partition: Stretch):
        if not partition.file:
            return
        fs, _ = _fs(self.path)
        rows: list[list] = []
        held = 0
        with fs.open_input_file(partition.file) as file:
            for head in read_records(file, partition.begin, partition.end, partition.file.endswith(".gz"), self._wanted, self.payload):
                rows.append(_row(head, self.payload))
                held += len(rows[-1][-1] or b"")
                if len(rows) >= 2000 or held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _value(head: dict, column: str) -> str | None:
    got = head.get(_HEADERS[column].lower())
    if got and column == "payload_digest" and got.lower().startswith("sha1:") and len(got) == 37:
        return base64.b32decode(got[5:].upper()).hex()
    return got


def _row(head: dict, payload: bool) -> list:
    """A payload is what follows the HTTP headers of the block; its length is told by them, or else measured."""
    http, mark, body = head[""].partition(b"\r\n\r\n")
    if not head.get("content-type", "").startswith("application/http") or not mark:
        http, body = b"", head[""]
    told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    length = int(told[1]) if told else len(body) if payload else None
    revisit = head.get("warc-type") == "revisit"
    return [_value(head, c) for c in _HEADERS] + [length, body if payload and not revisit else None]


_ARROW = pa.schema([(c, pa.string()) for c in _HEADERS] + [("payload_length", pa.int64()), ("payload", pa.binary())])


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


@dataclass
class Written(WriterCommitMessage):
    name: str
    cuts: list[int]


class WarcWriter(DataSourceArrowWriter):
    """Each task attempt writes a file of its own; the commit lists the files of the attempts that count, and readers see these only."""

    def __init__(self, options: dict):
        self.path, self.compress = options["path"], options.get("compression", "gzip") == "gzip"

    def write(self, iterator) -> WriterCommitMessage:
        fs, top = _fs(self.path)
        name, at, cuts = f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compress, 0, [0]
        fs.create_dir(top, recursive=True)
        with fs.open_output_stream(f"{top}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    record = encode_record(row, self.compress)
                    out.write(record)
                    at += len(record)
                    if at - cuts[-1] >= STRETCH:
                        cuts.append(at)
        if cuts[-1] < at:
            cuts.append(at)
        return Written(name, cuts)

    def commit(self, messages) -> None:
        fs, top = _fs(self.path)
        fs.create_dir(top, recursive=True)
        entries = [{"name": m.name, "cuts": m.cuts} for m in messages if m and len(m.cuts) > 1]
        with fs.open_output_stream(f"{top}/_manifest-{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps(entries).encode())

    def abort(self, messages) -> None:
        fs, top = _fs(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{top}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives under path, one row each; a revisit's payload is null. With payload=False all are, and no block is decoded."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def write_warc(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """df has the columns of SCHEMA; missing ones are null."""
    register(df.sparkSession)
    kinds = dict(x.rsplit(" ", 1) for x in SCHEMA.split(", "))
    full = df.select([F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    full.write.format("warc").option("compression", compression).mode("append").save(path)


def _numbered(rows: DataFrame, total: int) -> DataFrame:
    """rows with copy, 1 but for rows that are equal in id, address and payload, which are numbered: every record has a name of its own."""
    rows = rows.withColumn("__same", F.xxhash64("page_id", "target_uri", "digest"))
    equal = materialise(rows.groupBy("__same").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "equal")
    if equal.isEmpty():
        return rows.withColumn("copy", F.lit(1)).drop("__same")
    marked = attach(rows, equal, ["__same"], "times", total)
    turn = F.row_number().over(Window.partitionBy("__same").orderBy("payload_length"))
    lone = marked.where("times is null").withColumn("copy", F.lit(1))
    return lone.unionByName(marked.where("times is not null").withColumn("copy", turn)).drop("__same", "times")


def captures(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows for write_warc, one for each row of df, revisits for payloads that another row holds.

    Of payloads that are equal and have min_bytes at least, the row with the largest id is the response; rows
    that repeat that id and payload are responses too. Others are revisits that refer to it. A null payload is
    empty; a null url has no header; null ids never win and rows all of whose ids are null stay responses.
    """
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("target_uri"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_length": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    total = df.select(F.lit(1)).count()
    # The response that revisits refer to is told by id and, of rows that repeat the id, by the greatest address.
    best = F.max(F.struct("page_id", "target_uri"))
    classes = rows.where(F.col("payload_length") >= min_bytes).groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
    classes = classes.select("digest", F.col("best.page_id").alias("keep"), F.col("best.target_uri").alias("keep_uri"), "copies")
    joined = attach(_numbered(rows, total), materialise(classes.where("copies > 1 and keep is not null"), "payloads"), ["digest"], "copies", total)
    again = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))

    def record(page, uri, copy):
        named = [F.coalesce(x.cast("string"), F.lit("null")) for x in (page, uri, copy)]
        return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(F.concat_ws(":", *named, "digest")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))

    return joined.select(
        record(F.col("page_id"), F.col("target_uri"), F.col("copy")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(again, record(F.col("keep"), F.col("keep_uri"), F.lit(1))).alias("refers_to"),
        F.concat(F.lit("sha1:"), F.col("digest")).alias("payload_digest"),
        F.col("page_id").cast("string").alias("page_id"),
        F.when(again, F.col("keep")).cast("string").alias("refers_to_page"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def archive_pages(df: DataFrame, path: str | None = None, **names) -> DataFrame:
    """Write df's captures as archives under path and read them back (columns of SCHEMA). An empty table gives none."""
    spark = df.sparkSession
    path = path or new_path(spark, "warc")
    write_warc(captures(df, **names), path)
    return read_warc(spark, path)
