"""Places of rows in an order, however many rows share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_parts

#: Rows that one task of the ordering takes, about.
ROWS_PER_PART = 1_000_000


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (key, ...) with idx, their place within key by order (ascending, null first), and n, how many rows the key has.

    The order must be total. Rows are dealt by ranges of (key, *order), so a key of any size lies in as many tasks as
    it fills; a range is sorted in one task, written, and shifted by the counts of those before. rows is read more than once, so it must be a table
    or come from one without chance. The result's written_to is the written table, which discard() removes when nothing reads it any more.
    """
    spark, by = rows.sparkSession, ["key", *order]
    parts = max(shuffle_parts(spark), -(-rows.count() // ROWS_PER_PART))
    rows = materialise(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "ordered")
    path, rows = rows.written_to, rows.withColumn("part", F.shiftright("at", 33))
    counts = rows.groupBy("part", "key").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    own = Window.partitionBy("key")
    counts = counts.withColumn("n", F.sum("here").over(own)).withColumn("shift", F.sum("here").over(own.orderBy("part")) - F.col("here") - F.col("first"))
    out = rows.join(counts.select("part", "key", "n", "shift"), ["part", "key"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")
    out.written_to = path
    return out
