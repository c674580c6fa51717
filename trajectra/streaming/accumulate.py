"""The training loop's state as Structured Streaming: mini-batches of trajectories, groups that pass, coefficients, best scores.

Everything that must outlive a failure is in the query's checkpoint or in tables keyed by batch id, so a batch that
is replayed writes what it wrote before.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.curriculum import group_band, scheduled


@dataclass
class Accumulator:
    """A foreachBatch function: appends the groups of a mini-batch that are in the scheduled band, until target groups
    are held. Rows of the group that would be over the target are dropped, not kept for later."""

    out: str
    target: int
    points: list[dict] = field(default_factory=list)
    steps: int = 1
    low: float = 0.01
    high: float = 0.99
    max_tries: int = 0
    done: bool = False

    def held(self, spark: SparkSession, before: int) -> int:
        try:
            rows = spark.read.parquet(self.out)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return 0
            raise
        return rows.where(F.col("batch") < before).select("uid").distinct().count()

    def __call__(self, df: DataFrame, batch: int) -> None:
        if self.max_tries > 0 and batch >= self.max_tries:
            raise RuntimeError(f"{self.max_tries} mini-batches didn't give {self.target} groups")
        have = self.held(df.sparkSession, batch)
        if have >= self.target:
            self.done = True
            return
        band = scheduled(self.points, batch / self.steps, {"filter_low": self.low, "filter_high": self.high})
        df.persist()  # read for the groups' means, for the room and for the rows
        try:
            kept = group_band(df, band["filter_low"], band["filter_high"])
            room = kept.select("uid").distinct().orderBy("uid").limit(self.target - have)
            rows = kept.join(room, "uid", "left_semi").withColumn("batch", F.lit(batch).cast("long"))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.out)
        finally:
            df.unpersist()


def accumulate(source: DataFrame, sink: Accumulator, checkpoint: str) -> None:
    query = source.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def controlled_coefficients(stream: DataFrame, controller) -> DataFrame:
    """run, step, used, next: a controller (operators.kl) as state of a run. Input: run, step, and the step's kl, n (its
    steps' worth) and acc; a null acc is none."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ctl = copy.copy(controller)
        if state.exists:
            ctl.beta = state.get[0]
        out = []
        for r in pd.concat(list(batches)).sort_values("step").itertuples():
            used = ctl.beta
            ctl.update(r.kl, r.n, None if pd.isna(r.acc) else r.acc)
            out.append((key[0], r.step, used, ctl.beta))
        state.update((ctl.beta,))
        yield pd.DataFrame(out, columns=["run", "step", "used", "next"])

    return stream.groupBy("run").applyInPandasWithState(update, "run string, step long, used double, next double", "beta double", "append", GroupStateTimeout.NoTimeout)


def best_scores(stream: DataFrame) -> DataFrame:
    """val_name, best: a running maximum, in update mode."""
    return stream.groupBy("val_name").agg(F.max("score").alias("best"))
