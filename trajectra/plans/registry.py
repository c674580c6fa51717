"""User functions: reward rules by name or from a file, row and batch kinds, functions on chunks of a batch."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import rewards
from ..operators.batch import size_of

REWARDS: dict[str, Callable[..., DataFrame]] = {
    "full": rewards.grouped_reward,
    "perception": rewards.perception_reward,
    "answer_length": rewards.answer_length_reward,
    "answer_perception": rewards.answer_perception_reward,
    "answer": rewards.answer_reward,
    "baseline": rewards.baseline_reward,
    "batch": rewards.batch_reward,
    "thinking": rewards.thinking_reward,
}


def load_function(spec: str) -> Callable:
    """A rule by name, or path.py:function; without a function, main."""
    if spec in REWARDS:
        return REWARDS[spec]
    path, _, name = spec.rpartition(":") if ".py:" in spec else (spec, "", "main")
    found = importlib.util.spec_from_file_location("user_rule", path)
    if found is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(found)
    found.loader.exec_module(module)
    return getattr(module, name)


def score_rows(df: DataFrame, rule: Callable[[dict], dict], columns: list[str], outputs: list[str]) -> DataFrame:
    """A rule of one row at a time, in Arrow batches: each of outputs as a double."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            made = [rule(r) for r in rows[columns].to_dict("records")]
            yield pd.DataFrame({"row_id": rows["row_id"], **{o: [float(m[o]) for m in made] for o in outputs}})

    scored = df.select("row_id", *columns).mapInPandas(run, "row_id long, " + ", ".join(f"{o} double" for o in outputs))
    return df.join(scored, "row_id")


def _records(rows: pa.Table, columns: list[str]) -> list[dict]:
    """A dict a row; a null number is NaN, as in pandas."""
    values = [[float("nan") if x is None else x for x in c.to_pylist()] if pa.types.is_floating(c.type) or pa.types.is_integer(c.type) else c.to_pylist() for c in map(rows.column, columns)]
    return [dict(zip(columns, x)) for x in zip(*values)] if columns else [{} for _ in range(rows.num_rows)]


def score_batches(df: DataFrame, rule: Callable[[list[dict]], list[dict]], columns: list[str], outputs: list[str], batch: str = "batch_id") -> DataFrame:
    """A rule that needs its whole batch at once; a batch is one task's, so of bounded size. A task takes its batches one after another
    from sorted rows, many to an Arrow batch, and adds outputs to the rows: there is no call of the worker a batch, and no join."""
    kept = ["row_id", *[c for c in df.columns if c != "row_id"]]
    rows = df.select(*kept, F.row_number().over(Window.partitionBy(batch).orderBy("row_id")).alias("__turn"))
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(o, T.DoubleType()) for o in outputs])

    def scored(whole: pa.Table, starts: list[int]) -> Iterator[pa.RecordBatch]:
        records, made = _records(whole, columns), []
        for a, b in zip(starts, [*starts[1:], len(records)]):
            got = rule(records[a:b])
            if len(got) != b - a:
                raise ValueError(f"the rule gave {len(got)} records for {b - a} rows")
            made += got
        out = whole.drop_columns("__turn")
        for o in outputs:
            out = out.append_column(o, pa.array([float(m[o]) for m in made], pa.float64()))
        yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rows in batches:
            first = np.flatnonzero(rows.column("__turn").to_numpy() == 1)
            # What is held ends with a batch that may go on; it is whole where the next one begins.
            if len(first):
                last = int(first[-1])
                whole = pa.Table.from_batches([*held, rows.slice(0, last)])
                if whole.num_rows:
                    yield from scored(whole, np.flatnonzero(whole.column("__turn").to_numpy() == 1).tolist())
                held, rows = [], rows.slice(last)
            if rows.num_rows:
                held.append(rows)
        if held:
            yield from scored(pa.Table.from_batches(held), [0])

    return rows.mapInArrow(run, schema)


def on_chunks(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, parts: int) -> DataFrame:
    """function on each of parts contiguous chunks of the batch, whole and in order of row_id; results together. A chunk is one task."""
    part = F.floor(F.col("row_id") * parts / size_of(df))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return function(rows.drop(columns="__part").sort_values("row_id", ignore_index=True))

    return df.withColumn("__part", part).groupBy("__part").applyInPandas(run, schema)


def on_given_chunks(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, part: str) -> DataFrame:
    """function on chunks that the caller has dealt, told by column part; what it returns for each, without order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return function(rows.sort_values("row_id", ignore_index=True))

    return df.groupBy(part).applyInPandas(run, schema)


def keep_rows(df: DataFrame, predicate: Callable[[pd.Series], pd.Series], column: str) -> DataFrame:
    return df.where(F.pandas_udf(predicate, "boolean")(F.col(column)))
