"""Where records and samples go: JSON, metric lines, console, several sinks at once, checkpoints and their retention."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import checkpoint_step, unflatten
from . import commits


def write_json_lines(df: DataFrame, path: str) -> None:
    """A line a row; null fields are left out, other characters stay as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_json_array(df: DataFrame, path: str, order: str = "row_id") -> None:
    """The rows, in the order of a dense row number that is left out, as one JSON array over the files of a folder: joined
    in the order of their names, the files are the array. Null fields are left out, other characters stay as they are."""
    body = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != order]), {"ignoreNullFields": "true"})
    first, last = F.col(order) == 0, F.col(order) == df.agg(F.max(order)).scalar()
    line = F.concat(F.when(first, "[").otherwise(","), body, F.when(last, "]").otherwise(""))
    # Without rows the array is empty, but there.
    none = df.sparkSession.range(1).where(df.agg(F.count(F.lit(1))).scalar() == 0).select(F.col("id").alias(order), F.lit("[]").alias("value"))
    df.select(F.col(order).cast("long"), line.alias("value")).unionByName(none).repartitionByRange(order).sortWithinPartitions(order).select("value").write.mode("overwrite").text(path)


def write_files(df: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Write content (bytes) of each row to a file of that name in folder, on the workers, and give name and path. A name
    that occurs twice is written twice; tasks that are repeated write what they wrote."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        at, top = fs.FileSystem.from_uri(folder)
        at.create_dir(top, recursive=True)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for n, data in zip(names, batch.column(1).to_pylist()):
                with at.open_output_stream(f"{top}/{n}") as out:
                    out.write(data or b"")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([f"{folder}/{n}" for n in names], pa.string())], names=["name", "path"])

    return df.select(F.col(name).cast("string"), F.col(content).cast("binary")).mapInArrow(run, "name string, path string")


def metric_line(df: DataFrame, step: str = "step") -> DataFrame:
    """One column value: {"step": ..., nested by the slashes of the names}."""

    def nested(tree: dict, path: str = "") -> Column:
        parts = []
        for name, x in tree.items():
            parts.append((nested(x) if isinstance(x, dict) else F.col(f"`{x}`")).alias(name))
        return F.struct(*parts)

    tree = unflatten({c: c for c in df.columns if c != step})
    return df.select(F.to_json(F.struct(F.col(step).alias("step"), *[(nested(x) if isinstance(x, dict) else F.col(f"`{x}`")).alias(k) for k, x in tree.items()])).alias("value"))


def append_metrics(df: DataFrame, path: str, step: str = "step") -> None:
    metric_line(df, step).write.mode("append").text(path)


def show_number(x: float) -> str:
    """Three decimals, unless it is written with an exponent."""
    return repr(x) if re.fullmatch(r"-?\d(\.\d+)?e[+-]\d+", repr(x)) else repr(round(x, 3))


def console(df: DataFrame) -> str:
    lines = []
    for r in df.collect():
        lines += [f"{k}: {show_number(v) if isinstance(v, float) else v}" for k, v in r.asDict().items()]
    print("\n".join(lines))
    return "\n".join(lines)


SINKS: dict[str, Callable[[DataFrame, str], object]] = {"console": lambda df, path: console(df), "file": append_metrics}


class Tracker:
    """Writes a record to several sinks by name. Others, such as those of tracking services, are added with add_sink."""

    def __init__(self, names: list[str], path: str):
        if unknown := [n for n in names if n not in SINKS]:
            raise ValueError(f"unknown sinks: {', '.join(unknown)}")
        self.names, self.path = names, path

    def log(self, df: DataFrame) -> None:
        for name in self.names:
            SINKS[name](df, self.path)


def add_sink(name: str, write: Callable[[DataFrame, str], object]) -> None:
    SINKS[name] = write


def log_samples(samples: DataFrame, path: str, step: int) -> None:
    samples.withColumn("step", F.lit(step)).write.mode("append").parquet(path)


def save_checkpoint(state: DataFrame, folder: str, step: int, best: int | None, score: float | None, after: int | None = None) -> dict:
    """State as Parquet in a global_step_N of its own, then a commit that names it: whoever reads finds this step whole or the one
    before. after: see commits.commit, which raises Conflict if another writer was first."""
    record = {"last_global_step": step, "best_global_step": best, "best_val_reward_score": None if score is None else round(score, 4)}
    return commits.commit(state, folder, f"global_step_{step}", record, after)


def latest_checkpoint(spark: SparkSession, folder: str) -> tuple[str, dict] | None:
    found = commits.latest(spark, folder)
    return found and (f"{folder}/{found['data']}", found)


def obsolete_checkpoints(paths: DataFrame, current: int, best: int | None, limit: int, path: str = "path") -> DataFrame:
    """path, step of what retention removes: of the steps before current all but the newest limit - 1, and never the best. A limit of 0 or less keeps all."""
    steps = paths.select(path, checkpoint_step(F.col(path)).alias("step")).where(F.col("step").isNotNull() & (F.col("step") < current))
    if limit <= 0:
        return steps.where(F.lit(False))
    turn = F.row_number().over(Window.orderBy(F.desc("step")))
    out = steps.withColumn("__n", turn).where(F.col("__n") > limit - 1).drop("__n")
    return out if best is None else out.where(F.col("step") != best)
