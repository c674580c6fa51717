import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from trajectra.llm import warc
from trajectra.llm.warc import archive_pages, read_warc, write_warc

PAGES = "page_id long, url string, html string"


def pages(spark):
    long = "<p>é</p>" * 400
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, None), (4, "http://c", "short"), (5, "http://d", "short"), (None, "http://e", long), (2, "http://b", long), (6, "u\r\nX: y", "z" * 200_000)]
    return spark.createDataFrame(rows, PAGES)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    df = pages(spark)
    write_warc(warc.captures(df), str(tmp_path / "w"), compression)
    rows = read_warc(spark, str(tmp_path / "w")).collect()
    html = {r["page_id"]: r["html"] or "" for r in df.collect()}
    assert len(rows) == df.count()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to_page"]) for r in rows)
    assert kinds == sorted([("1", "revisit", "2"), ("2", "response", None), ("2", "response", None), ("3", "response", None), ("4", "response", None), ("5", "response", None), ("None", "revisit", "2"), ("6", "response", None)])
    assert len({r["record_id"] for r in rows}) == len(rows)
    ids: dict = {}
    for r in rows:
        ids.setdefault(r["page_id"], set()).add(r["record_id"])
    for r in rows:
        text = html[int(r["page_id"]) if r["page_id"] else None].encode()
        assert r["payload_length"] == len(text) and r["payload_digest"] == "sha1:" + hashlib.sha1(text).hexdigest()
        assert r["payload"] == (text if r["record_type"] == "response" else None)
        assert r["refers_to"] in ids[r["refers_to_page"]] if r["refers_to_page"] else r["refers_to"] is None


def test_filters_are_pushed_and_payloads_left(spark, tmp_path):
    write_warc(warc.captures(pages(spark)), str(tmp_path / "w"))
    found = read_warc(spark, str(tmp_path / "w")).where((F.col("record_type") == "revisit") & (F.col("target_uri") == "http://a"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]
    assert [r["page_id"] for r in found.collect()] == ["1"]
    bare = read_warc(spark, str(tmp_path / "w"), payload=False)
    assert bare.where("payload is not null").count() == 0 and bare.count() == 8
    assert bare.where("record_type in ('response') and target_uri like 'http://c%'").count() == 1


def test_unwanted_blocks_are_not_inflated(monkeypatch):
    row = dict.fromkeys(warc._HEADERS) | {"record_type": "response", "record_id": "<a>", "payload_length": 3_000_000, "payload": bytes(range(250)) * 12_000}
    data = warc.encode_record(row, True) * 3
    inflated = []

    class Counting:
        def __init__(self, wbits):
            self.inner = zlib_object(wbits)

        def decompress(self, *args):
            out = self.inner.decompress(*args)
            inflated.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.inner, name)

    zlib_object = warc.zlib.decompressobj
    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    assert list(warc.read_records(io.BytesIO(data), 0, len(data), True, lambda h: False, True)) == []
    assert sum(inflated) <= 3 * (1 << 15)


@pytest.mark.parametrize("suffix", ["warc", "warc.gz"])
def test_archives_of_other_makers(spark, tmp_path, suffix):
    record = b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Target-URI: http://x\r\nWARC-Payload-Digest: sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    body = b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\npayload" + b"q" * 100_000
    records = [record % (b"warcinfo", 4, b"info"), record % (b"response", len(body), body)] * 2
    (tmp_path / f"a.{suffix}").write_bytes(b"".join(gzip.compress(r) for r in records) if suffix.endswith("gz") else b"".join(records))
    rows = read_warc(spark, str(tmp_path)).collect()
    assert [r["record_type"] for r in rows] == ["warcinfo", "response"] * 2
    assert rows[1]["payload"] == b"payload" + b"q" * 100_000 and rows[1]["payload_digest"] == "00" * 20


def test_clashing_columns_are_not_read(spark, tmp_path):
    df = pages(spark).selectExpr("*", "html as payload", "url as digest", "page_id as keep", "1 as copies", "2 as copy", "page_id as times", "url as target_uri")
    plain, more = (sorted((str(r["page_id"]), r["record_type"], str(r["refers_to_page"]), r["payload_digest"]) for r in archive_pages(x, str(tmp_path / n)).collect()) for x, n in ((pages(spark), "a"), (df, "b")))
    assert plain == more and len(plain) == 8


def test_empty(spark):
    assert archive_pages(spark.createDataFrame([], PAGES)).count() == 0
