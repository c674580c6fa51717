"""Metrics of a step gathered by the same pass that writes its batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the types whose size doesn't hang on the value.
WIDTHS = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8}


def _bytes(c: Column, kind: T.DataType) -> Column:
    if type(kind) in WIDTHS:
        size = F.lit(WIDTHS[type(kind)])
    elif isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(c)
    elif isinstance(kind, T.ArrayType) and type(kind.elementType) in WIDTHS:
        size = F.size(c) * WIDTHS[type(kind.elementType)]
    else:
        size = F.octet_length(F.to_json(F.struct(c.alias("x"))))
    return F.coalesce(F.sum(F.when(c.isNotNull(), size).cast("long")), F.lit(0))


def size_report(df: DataFrame, columns: list[str] | None = None) -> dict[str, Column]:
    """Rows, and the bytes of each column's values: by width, of texts and bytes by length, of other nested types as JSON. Nulls have none."""
    return {"rows": F.count(F.lit(1)), **{f"bytes/{f.name}": _bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema if columns is None or f.name in columns}}


def spread(prefix: str, c: Column) -> dict[str, Column]:
    return {f"{prefix}/mean": F.avg(c), f"{prefix}/max": F.max(c), f"{prefix}/min": F.min(c)}


def length_report(name: str, length: str, cap: int) -> dict[str, Column]:
    return {**spread(name, F.col(length)), f"{name}/clip_ratio": F.avg((F.col(length) == cap).cast("double"))}


class TokenReport:
    """Statistics of the valid tokens of array columns, without a row a token: each row's arrays are reduced first. columns: names of the
    record to array columns. Tokens whose mask isn't above 0, and null ones, don't count; nor do null arrays."""

    def __init__(self, columns: dict[str, str], mask: str = "mask"):
        self.columns, self.mask = columns, mask
        self.made: dict[str, Column] = {}

    def _valid(self, array: Column) -> Column:
        kept = F.zip_with(array, F.col(self.mask), lambda x, m: F.when(m > 0, x.cast("double")))
        return F.filter(kept, lambda x: x.isNotNull())

    def _reduced(self, name: str, array: Column) -> None:
        """Count, mean, sum of squared deviations, least and most of one row's array."""
        self.made[f"__m_{name}"] = self._valid(array)
        kept = F.col(f"__m_{name}")
        n = F.coalesce(F.size(kept), F.lit(0)).cast("double")
        total = F.aggregate(kept, F.lit(0.0), lambda s, x: s + x)
        self.made[f"__s_{name}"] = F.when(n > 0, F.struct(n.alias("n"), (total / n).alias("mean"), F.array_max(kept).alias("max"), F.array_min(kept).alias("min")))
        at = F.col(f"__s_{name}")
        self.made[f"__d_{name}"] = F.when(at.isNotNull(), F.aggregate(F.transform(kept, lambda x: (x - at["mean"]) * (x - at["mean"])), F.lit(0.0), lambda s, x: s + x))

    def record(self) -> dict[str, Column]:
        out = {}
        for name, column in self.columns.items():
            self._reduced(name, F.col(column))
            at = F.col(f"__s_{name}")
            out |= {f"{name}/mean": F.sum(at["n"] * at["mean"]) / F.sum(at["n"]), f"{name}/max": F.max(at["max"]), f"{name}/min": F.min(at["min"])}
        return out

    def variance(self, name: str, array: Column) -> Column:
        """Sample variance over all tokens of an array expression: squares within rows about their means, and of the rows' means. The
        latter by a difference of sums, which loses digits where the mean is many times the spread between rows."""
        self._reduced(name, array)
        at = F.col(f"__s_{name}")
        n, first = F.sum(at["n"]), F.sum(at["n"] * at["mean"])
        between = F.greatest(F.sum(at["n"] * at["mean"] * at["mean"]) - first * first / n, F.lit(0.0))
        return F.when(n > 1, (F.sum(F.col(f"__d_{name}")) + between) / F.when(n > 1, n - 1))

    def explained(self, returns: str, values: str) -> dict[str, Column]:
        left = self.variance("left", F.zip_with(F.col(returns), F.col(values), lambda r, v: r.cast("double") - v.cast("double")))
        return {"vf_explained_var": 1.0 - left / (self.variance("all", F.col(returns)) + 1e-5)}


def write_observed(batch: DataFrame, write: Callable[[DataFrame], None], record: dict[str, Column], tokens: TokenReport | None = None) -> dict[str, object]:
    """write(batch), and the record of aggregates over the rows that were written, by one pass: nothing is read twice. The
    aggregates sit in the writing stage, whose tasks Spark counts once however often they are tried; write must not shuffle what it
    gets, nor start two jobs on it. Aggregates can't be distinct or windowed. Without rows all but counts are null."""
    seen = Observation()
    made = tokens.made if tokens else {}
    if clash := set(made) & set(batch.columns):
        raise ValueError(f"columns in the way: {', '.join(sorted(clash))}")
    rows = batch
    for name, column in made.items():
        rows = rows.withColumn(name, column)
    write(rows.observe(seen, *[c.alias(k) for k, c in record.items()]).select(*[F.col(f"`{c}`") for c in batch.columns]))
    got = seen.get
    return {k: got.get(k) for k in record}
