"""Groups gathered over mini-batches into training batches, as the state of a run.

Unlike accumulate.Accumulator, which fills one batch in a folder, this is a query that goes on: each run's state holds the groups of its open batch
and how many mini-batches it has tried; a full batch comes out, and the next is begun.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.curriculum import HIGH, LOW, scheduled

OUT = "run string, step long, place long, uid string, tries long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class GroupCollector(StatefulProcessor):
    """Input: run, mini, uid, acc, a row a response. Mini-batches are taken in order of mini, their groups in order of uid."""

    def __init__(self, target: int, low: float, high: float, points: list[dict], steps: int, max_tries: int, idle_ms: int):
        self.target, self.band, self.points, self.steps, self.max_tries, self.idle_ms = target, {"filter_low": low, "filter_high": high}, points, steps, max_tries, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "uid string")
        self.progress = handle.getValueState("progress", "step long, tries long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        step, tries = self.progress.get() if self.progress.exists() else (0, 0)
        held = [x[0] for x in self.held.get()] if self.held.exists() else []
        out = []
        frame = pd.concat(list(rows))
        for _, mini in frame.groupby("mini", sort=True):
            tries += 1
            band = scheduled(self.points, step / self.steps, self.band)
            mean = mini.groupby("uid", sort=True)["acc"].mean()
            held += mean.index[(mean > band["filter_low"]) & (mean < band["filter_high"])].tolist()
            if len(held) >= self.target:
                # What is over the target goes, as the batch is cut to its size.
                out += [(key[0], step, i, uid, tries) for i, uid in enumerate(held[: self.target])]
                step, tries, held = step + 1, 0, []
            elif 0 < self.max_tries <= tries:
                raise RuntimeError(f"run {key[0]}: {tries} mini-batches didn't give {self.target} groups, but {len(held)}")
        self.progress.update((step, tries))
        if held:
            self.held.put([(x,) for x in held])
        else:
            self.held.clear()
        if self.idle_ms > 0:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=["run", "step", "place", "uid", "tries"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A run without mini-batches for so long has ended; its open batch goes with its state."""
        self.held.clear()
        self.progress.clear()
        return iter(())

    def close(self) -> None:
        pass


def collect_groups(stream: DataFrame, target: int, low: float = LOW, high: float = HIGH, points: list[dict] | None = None, steps: int = 1, max_tries: int = 0, idle_ms: int = 0) -> DataFrame:
    """run, step, place, uid, tries: batches of target groups each, in the order in which their groups were found.

    stream has run, mini, uid and acc, a row a response; all rows of a mini-batch come in one trigger. A group is kept if its mean acc lies strictly
    between low and high, or the bounds of the schedule at step / steps. A batch that max_tries mini-batches don't fill (0: no limit) ends the
    query with an error. With idle_ms a run that gets nothing for so long is forgotten. A null acc is left out of its group's mean; a
    group of nulls isn't kept. Start the query within keyed_state(spark). Where the source is a stream of epochs, it begins
    again by itself when it has been read to its end.
    """
    rows = stream.selectExpr("cast(run as string) as run", "cast(mini as long) as mini", "cast(uid as string) as uid", "cast(acc as double) as acc")
    processor = GroupCollector(target, low, high, points or [], steps, max_tries, idle_ms)
    return rows.groupBy("run").transformWithStateInPandas(processor, OUT, "Append", "ProcessingTime" if idle_ms > 0 else "None")


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which lists, values and timers need; the session's setting is back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)
