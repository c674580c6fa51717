"""User rules called from SQL: table functions whose schema comes from their arguments."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


@dataclass
class Planned(AnalyzeResult):
    """What analysis hands to the tasks: the rule's source goes with the plan, so workers need no file."""

    source: str = ""
    function: str = ""
    id: str = "row_id"
    outputs: tuple[str, ...] = ()


def _rule(source: str, function: str) -> Callable:
    space: dict = {}
    exec(compile(source, "rule", "exec"), space)  # noqa: S102  the caller's own rule
    return space[function]


def _word(a: AnalyzeArgument | None, name: str, default: str | None = None) -> str:
    if a is None and default is not None:
        return default
    if a is None or not a.isConstantExpression or not isinstance(a.value, str):
        raise ValueError(f"{name} must be a constant text")
    return a.value


def _plan(rows: AnalyzeArgument, rule: AnalyzeArgument, outputs: AnalyzeArgument, id: AnalyzeArgument | None, batch: AnalyzeArgument | None) -> Planned:
    if not rows.isTable:
        raise ValueError("the first argument must be TABLE(...)")
    path, _, function = _word(rule, "rule").rpartition(":")
    with open(path, encoding="utf-8") as f:
        source = f.read()
    try:
        found = callable(_rule(source, function))
    except KeyError:
        found = False
    if not found:
        raise ValueError(f"{path} has no function {function}")
    key, names = _word(id, "id", "row_id"), tuple(x.strip() for x in _word(outputs, "outputs").split(","))
    kinds = {f.name: f.dataType for f in rows.dataType}
    if missing := [c for c in [key, *([] if batch is None else [_word(batch, "batch")])] if c not in kinds]:
        raise ValueError(f"no column {', '.join(missing)}")
    schema = T.StructType([T.StructField(key, kinds[key])] + [T.StructField(o, T.DoubleType()) for o in names])
    dealt = {} if batch is None else {"partitionBy": [PartitioningColumn(f"`{_word(batch, 'batch')}`")], "orderBy": [OrderingColumn(f"`{key}`")]}
    return Planned(schema=schema, source=source, function=function, id=key, outputs=names, **dealt)


def _numbers(planned: Planned, row: dict, made: dict) -> tuple:
    return (row[planned.id], *[None if made[o] is None else float(made[o]) for o in planned.outputs])


class BatchRule:
    """batch_rule(TABLE(t), rule => 'path.py:function', outputs => 'a, b', id => 'row_id', batch => 'uid'): the rule gets the rows of a
    batch, in order of id, as a list of dicts and gives as many. Instead of batch the caller may write PARTITION BY and ORDER BY
    after TABLE(t). A batch is one task's list, so of bounded size. Rows whose batch is null are one batch. No rows, no calls."""

    def __init__(self, planned: Planned):
        self.planned, self.rule, self.rows = planned, _rule(planned.source, planned.function), []

    @staticmethod
    def analyze(rows: AnalyzeArgument, rule: AnalyzeArgument, outputs: AnalyzeArgument, id: AnalyzeArgument | None = None, batch: AnalyzeArgument | None = None) -> Planned:
        return _plan(rows, rule, outputs, id, batch)

    def eval(self, rows: Row, rule: str, outputs: str, id: str | None = None, batch: str | None = None) -> None:
        self.rows.append(rows.asDict())

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        made = self.rule(self.rows)
        if len(made) != len(self.rows):
            raise ValueError(f"the rule gave {len(made)} records for {len(self.rows)} rows")
        for row, m in zip(self.rows, made):
            yield _numbers(self.planned, row, m)


class RowRule:
    """row_rule(TABLE(t), rule => 'path.py:function', outputs => 'a, b', id => 'row_id'): the rule gets one row as a dict."""

    def __init__(self, planned: Planned):
        self.planned, self.rule = planned, _rule(planned.source, planned.function)

    @staticmethod
    def analyze(rows: AnalyzeArgument, rule: AnalyzeArgument, outputs: AnalyzeArgument, id: AnalyzeArgument | None = None) -> Planned:
        return _plan(rows, rule, outputs, id, None)

    def eval(self, rows: Row, rule: str, outputs: str, id: str | None = None) -> Iterator[tuple]:
        row = rows.asDict()
        yield _numbers(self.planned, row, self.rule(row))


def register_rules(spark: SparkSession) -> None:
    spark.udtf.register("batch_rule", udtf(BatchRule))
    spark.udtf.register("row_rule", udtf(RowRule))

