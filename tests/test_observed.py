"""Metrics of a batch from the pass that writes it."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from trajectra.sources.observed import TokenReport, length_report, size_report, spread, write_observed

ROWS = [
    (1, 0.5, "é", 3, [1.0, 2.0, 9.0], [1.0, 2.5, 4.0], [1.0, 1.0, 0.0]),
    (2, None, None, 2, [4.0, None], [3.0, 7.0], [1.0, 1.0]),
    (3, 1.5, "ab", 0, [], [], []),
    (4, -1.0, "", 5, None, None, None),
    (4, -1.0, "", 5, [8.0], [8.0], [0.0]),
]
SCHEMA = "id long, score double, text string, length int, ret array<double>, val array<double>, mask array<double>"


def _record(df):
    tokens = TokenReport({"returns": "ret"})
    return {**spread("score", F.col("score")), **length_report("length", "length", 5), **tokens.record(), **tokens.explained("ret", "val"), **size_report(df)}, tokens


def test_record_is_that_of_the_rows_written_and_they_are_read_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3).mapInPandas(count, SCHEMA)
    record, tokens = _record(df)
    got = write_observed(df, lambda x: x.write.parquet(str(tmp_path / "out")), record, tokens)
    assert reads.value == len(ROWS)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).columns) == sorted(df.columns)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(ROWS)
    assert got["rows"] == 5 and got["score/mean"] == 0.0 and got["length/clip_ratio"] == 0.4
    assert (got["returns/mean"], got["returns/max"], got["returns/min"]) == (7 / 3, 4.0, 1.0)
    # Valid pairs: (1, 1), (2, 2.5), (4, 3); the null return has no difference.
    left, whole = statistics.variance([0.0, -0.5, 1.0]), statistics.variance([1.0, 2.0, 4.0])
    assert math.isclose(got["vf_explained_var"], 1 - left / (whole + 1e-5), rel_tol=1e-12)
    assert got["bytes/text"] == 4 and got["bytes/id"] == 40 and got["bytes/ret"] == 8 * 6


def test_empty_table_has_nulls_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.where("id > 1").write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in")).where("id = 0")
    record, tokens = _record(df)
    got = write_observed(df, lambda x: x.write.parquet(str(tmp_path / "out")), record, tokens)
    assert got["rows"] == 0 and got["bytes/text"] == 0
    assert got["score/mean"] is None and got["returns/max"] is None and got["vf_explained_var"] is None


def test_columns_in_the_way_raise(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("__m_returns", F.lit(1))
    record, tokens = _record(df)
    with pytest.raises(ValueError, match="in the way"):
        write_observed(df, lambda x: x.count(), record, tokens)
