"""Event files byte by byte, and which of them count."""

import os
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from trajectra.sources import event_files


def _files(path):
    """Without hidden ones and folders of tasks that didn't end."""
    return sorted(f for f in os.listdir(path) if f[0] not in "._") if os.path.exists(path) else []


def test_checksum_of_known_texts():
    assert event_files.crc32c(b"123456789") == 0xE3069283
    assert event_files.crc32c(b"\x00" * 32) == 0x8A9136AA and event_files.crc32c(b"") == 0


def test_bytes_of_a_record():
    event = event_files.scalar_event(1.5, 300, "a/b", 0.5)
    assert event == b"\x09" + struct.pack("<d", 1.5) + b"\x10\xac\x02" + b"\x2a\x0c" + b"\x0a\x0a" + b"\x0a\x03a/b" + b"\x15" + struct.pack("<f", 0.5)
    framed = event_files.frame(event)
    assert framed[:8] == struct.pack("<Q", len(event)) and framed[12:-4] == event
    assert list(event_files.unframed(framed * 2)) == [event] * 2
    for bad in (framed[:-1], framed[:5], framed[:20] + b"!" + framed[21:], b"\x01" + framed[1:]):
        with pytest.raises(ValueError):
            list(event_files.unframed(bad))
    assert list(event_files.scalars(event_files.scalar_event(0.0, -1, "é", -2.0))) == [(-1, "é", -2.0, 0.0)]
    assert list(event_files.scalars(event_files.version_event(0.0))) == []


def test_round_trip_leaves_nulls_and_other_columns_out(spark, tmp_path):
    at = f"file://{tmp_path}/log"
    rows = spark.createDataFrame([(1, 0.1, 3, "x"), (2, None, 4, "y"), (None, 1.0, 5, "z"), (1, 0.1, 3, "x")], "step int, `actor/loss` double, n long, name string")
    event_files.write_events(rows.repartition(3), at, wall_time=7.0)
    event_files.write_events(rows.where("step = 2"), at)
    got = sorted(map(tuple, event_files.read_events(spark, at).collect()))
    near = struct.unpack("<f", struct.pack("<f", 0.1))[0]
    assert got == [(1, "actor/loss", near, 7.0), (1, "actor/loss", near, 7.0), (1, "n", 3.0, 7.0), (1, "n", 3.0, 7.0), (2, "n", 4.0, 0.0), (2, "n", 4.0, 7.0)]
    assert all(f.startswith("events.out.tfevents") for f in os.listdir(tmp_path / "log") if f[0] != ".")


def test_an_empty_table_and_a_folder_that_is_not_there(spark, tmp_path):
    at = str(tmp_path / "none")
    assert event_files.read_events(spark, at).collect() == []
    event_files.write_events(spark.createDataFrame([], "step int, x double"), at)
    assert event_files.read_events(spark, at).collect() == [] and _files(at) == []


def test_a_failed_task_leaves_no_file_that_counts(spark, tmp_path):
    at = str(tmp_path / "log")
    rows = spark.range(0, 100, 1, 4).select(F.col("id").alias("step"), F.when(F.col("id") == 90, F.raise_error("lost")).otherwise(F.col("id")).cast("double").alias("x"))
    with pytest.raises(PySparkException):
        event_files.write_events(rows, at)
    assert _files(at) == [] and event_files.read_events(spark, at).collect() == []
