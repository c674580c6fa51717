"""Shuffled epochs of a table as a stream of mini-batches whose position is two numbers, the epoch and the place in it.

The source itself yields only ranges of places; the rows at those places are computed where they are read. Its offset is in the
query's checkpoint, so a query that is stopped or killed goes on with the next mini-batch, and none is lost or given twice.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..functions.permutation import place_of, row_at
from ..runtime import ship

#: Places of one range at most: a larger mini-batch is several.
RANGE = 65_536


class EpochRanges(DataSource):
    """Format epoch_ranges: rows (epoch, first, last), a trigger's worth a mini-batch. Options: n, batch, epochs (0: without end),
    dropLast (a last mini-batch of an epoch that isn't full is left out)."""

    @classmethod
    def name(cls) -> str:
        return "epoch_ranges"

    def schema(self) -> str:
        return "epoch int, first long, last long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Ranges(int(self.options["n"]), int(self.options["batch"]), int(self.options.get("epochs", "0")), self.options.get("dropLast", "true").lower() == "true")


class _Ranges(SimpleDataSourceStreamReader):
    def __init__(self, n: int, batch: int, epochs: int, drop_last: bool):
        if batch < 1 or n < 0:
            raise ValueError("a mini-batch has one row at least, a table none at least")
        self.batch, self.epochs, self.end = batch, epochs, n - n % batch if drop_last else n

    def initialOffset(self) -> dict:
        return {"epoch": 0, "place": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        epoch, first = start["epoch"], start["place"]
        if not self.end or 0 < self.epochs <= epoch:
            return iter(()), start
        last = min(first + self.batch, self.end)
        rows = [(epoch, at, min(at + RANGE, last)) for at in range(first, last, RANGE)]
        return iter(rows), {"epoch": epoch + 1, "place": 0} if last == self.end else {"epoch": epoch, "place": last}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while start != end:
            rows, start = self.read(start)
            yield from rows

    def commit(self, end: dict) -> None:
        pass


def mini_batches(spark: SparkSession, n: int, batch: int, seed: int, epochs: int = 0, drop_last: bool = True) -> DataFrame:
    """A stream of epoch, place, mini (the number of the mini-batch in its epoch) and row_id, a mini-batch a trigger, each epoch in an order of its own.
    Join it with a table by row_id. Without rows, or with fewer than a mini-batch's and drop_last, it gives none."""
    ship(spark)
    spark.dataSource.register(EpochRanges)
    ranges = spark.readStream.format("epoch_ranges").options(n=n, batch=batch, epochs=epochs, dropLast=str(drop_last).lower()).load()
    if batch > RANGE:
        ranges = ranges.repartition(-(-batch // RANGE), "first")
    places = ranges.select("epoch", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("place"))
    return places.select("epoch", "place", F.floor(F.col("place") / batch).cast("long").alias("mini"), row_at(F.col("place"), n, seed, F.col("epoch")).alias("row_id"))


def shuffled_epochs(df: DataFrame, n: int, size: int, seed: int, first: int = 0) -> DataFrame:
    """df (with a dense row_id) n times, with epoch, place and mini as mini_batches gives them, without a sort or a shuffle."""
    rows = df.count()
    many = df.withColumn("epoch", F.explode(F.sequence(F.lit(first), F.lit(first + n - 1))))
    placed = many.withColumn("place", place_of(F.col("row_id"), rows, seed, F.col("epoch")))
    return placed.withColumn("mini", F.floor(F.col("place") / size).cast("long"))


def sampled(df: DataFrame, n: int, seed: int) -> DataFrame:
    """The n rows (by a dense row_id) that stand first in a shuffled order, with their place: by n computed ids and a join, not a sort of all."""
    rows = df.count()
    ids = df.sparkSession.range(min(n, rows)).select(F.col("id").alias("place"), row_at(F.col("id"), rows, seed).alias("row_id"))
    return df.join(ids, "row_id")


__all__ = ["EpochRanges", "mini_batches", "sampled", "shuffled_epochs"]
