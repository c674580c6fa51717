"""The ordered batch algebra. A batch is a DataFrame with row_id, dense from 0; all positions are statements about it."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import small_splits, written

#: Rows that are put in order by one task: more are dealt to ranges of the order, of about this many rows each.
RANGE_ROWS = 50_000


#: Rows that a task takes of a table whose rows cost much more than their bytes tell.
SPREAD_ROWS = 10_000


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df dealt by keys to tasks of about SPREAD_ROWS rows: a small file is one task, whatever is made of its rows."""
    return df.repartition(max(1, -(-df.count() // SPREAD_ROWS)), *keys)


def _ordered(df: DataFrame, order: tuple[str | Column, ...]) -> DataFrame:
    """df with __ord_part and __ord_at, which both rise with the order, __ord_at within a part.

    More than RANGE_ROWS rows are dealt by ranges, sorted and written once, and only the written table is read from then on: so an
    input that isn't the same each time gives a right numbering too. Rows whose order is equal are told apart by a hash of
    their values, and equal rows by where they were read, so that even a table of one row over and over has many ranges.
    """
    own = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    made = {f"__ord_k{i}": c for i, c in enumerate(order) if not isinstance(c, str)}
    keys = [c if isinstance(c, str) else f"__ord_k{i}" for i, c in enumerate(order)]
    keyed = df.withColumns({**made, "__ord_tie": F.xxhash64(*own or [F.lit(0)])})
    n = df.count()
    if n <= RANGE_ROWS:
        turn = F.row_number().over(Window.orderBy(*keys, "__ord_tie"))
        return keyed.withColumns({"__ord_part": F.lit(0).cast("long"), "__ord_at": turn.cast("long") - 1}).drop(*made, "__ord_tie")
    by = [*keys, "__ord_tie", "__ord_mark"]
    dealt = keyed.withColumn("__ord_mark", F.monotonically_increasing_id()).repartitionByRange(-(-n // RANGE_ROWS), *by).sortWithinPartitions(*by)
    with small_splits(df.sparkSession):
        table = written(dealt.drop(*made, "__ord_tie", "__ord_mark").withColumn("__ord_id", F.monotonically_increasing_id()))
    return table.withColumns({"__ord_part": F.shiftright("__ord_id", 33), "__ord_at": F.col("__ord_id").bitwiseAND((1 << 33) - 1)}).drop("__ord_id")


def _before(parts: DataFrame) -> DataFrame:
    """__p and __before, the sum of __s over the parts before it; a row a part."""
    return parts.select(F.col("__ord_part").alias("__p"), (F.sum("__s").over(Window.orderBy("__ord_part")) - F.col("__s")).alias("__before"))


def cumulative(df: DataFrame, *order: str | Column, value: Column | None = None, name: str = "total", dense: bool = False) -> DataFrame:
    """df with name: the sum of value (of 1, without one) over the rows up to and with each, in ascending order, nulls
    first. No task sorts all: ranges of the order are summed apart and shifted by the sums of the ranges before. With dense the order
    is one column of row numbers, which tell the ranges by themselves."""
    if dense:
        keyed = df.withColumns({"__ord_part": F.floor(F.col(order[0]) / RANGE_ROWS), "__ord_at": F.col(order[0])})
    else:
        keyed = _ordered(df, order)
    keyed = keyed.withColumn("__x", F.lit(1).cast("long") if value is None else value)
    before = _before(keyed.groupBy("__ord_part").agg(F.sum("__x").alias("__s")))
    inside = Window.partitionBy("__ord_part").orderBy("__ord_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = keyed.withColumn("__in", F.sum("__x").over(inside)).join(before, F.col("__ord_part") == F.col("__p"))
    return out.withColumn(name, F.col("__before") + F.col("__in")).drop("__ord_part", "__ord_at", "__p", "__before", "__in", "__x")


def with_row_id(df: DataFrame, *order: str | Column, name: str = "row_id") -> DataFrame:
    """df numbered from 0 in the given order, ascending, nulls first; rows that are equal in it are ordered by a hash of their values."""
    keyed = _ordered(df, order)
    before = _before(keyed.groupBy("__ord_part").agg(F.count(F.lit(1)).alias("__s")))
    out = keyed.join(before, F.col("__ord_part") == F.col("__p"))
    return out.withColumn(name, F.col("__before") + F.col("__ord_at")).drop("__ord_part", "__ord_at", "__p", "__before")


def from_columns(spark: SparkSession, columns: dict[str, Sequence], types: dict[str, str] | None = None) -> DataFrame:
    """A batch of columns that the driver holds: lists, tuples or numpy arrays (one of two dimensions or more gives
    arrays), all of one length. Other kinds of value and columns of different lengths raise."""
    if wrong := [k for k, v in columns.items() if not isinstance(v, (list, tuple, np.ndarray)) or getattr(v, "ndim", 1) == 0]:
        raise TypeError(f"a list, tuple or array is needed: {', '.join(wrong)}")
    sizes = {k: len(v) for k, v in columns.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"columns of different lengths: {sizes}")
    plain = [v.tolist() if isinstance(v, np.ndarray) else list(v) for v in columns.values()]
    rows = [(i, *values) for i, values in enumerate(zip(*plain))]
    if types and set(columns) <= set(types):
        return spark.createDataFrame(rows, ", ".join(["row_id bigint", *[f"`{k}` {types[k]}" for k in columns]]))
    if not rows:
        raise ValueError("an empty batch needs the types of its columns")
    made = spark.createDataFrame(rows, ["row_id", *columns])
    return made.withColumns({k: F.col(k).cast(t) for k, t in (types or {}).items() if k in columns})


def checked_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, whose rows each must have arrays of one length in all of columns; a row that hasn't raises when it is read."""
    same = F.lit(True)
    for c in columns[1:]:
        same = same & F.size(c).eqNullSafe(F.size(columns[0]))
    told = F.concat_ws(", ", *[F.concat(F.lit(f"{c} "), F.size(c).cast("string")) for c in columns])
    return df.withColumn("row_id", F.when(same, F.col("row_id")).otherwise(F.raise_error(F.concat(F.lit("arrays of different lengths: "), told))))


def merge_records(*records: dict) -> dict:
    """One record of all; a key of several must have one value."""
    out: dict = {}
    for record in records:
        for key, value in record.items():
            if key in out and out[key] != value:
                raise ValueError(f"{key} has different values: {out[key]!r} and {value!r}")
            out[key] = value
    return out


def size_of(df: DataFrame) -> Column:
    """Rows of df, as a scalar subquery."""
    return df.agg(F.count(F.lit(1))).scalar()


def select_columns(df: DataFrame, keys: list[str] | None) -> DataFrame:
    """Columns of keys that there are; None keeps all."""
    return df if keys is None else df.select("row_id", *[k for k in keys if k in df.columns and k != "row_id"])


def pop_columns(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(df with only keys, df without them), both with row_id; missing keys are passed over."""
    taken = [k for k in keys if k in df.columns and k != "row_id"]
    return df.select("row_id", *taken), df.drop(*taken)


def rename_columns(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones")
    if missing := [c for c in old if c not in df.columns]:
        raise KeyError(", ".join(missing))
    return df.withColumnsRenamed(dict(zip(old, new)))


def prompt_uid(*columns: str | Column) -> Column:
    """A name for a prompt that is the same on every attempt."""
    return F.sha2(F.concat_ws("\x1f", *columns), 256)


def _field(name: str):
    return lambda x: x[name]


def fold(df: DataFrame, parts: int, columns: list[str]) -> DataFrame:
    """parts rows, each with the values of consecutive rows as arrays."""
    n = size_of(df)
    items = F.sort_array(F.collect_list(F.struct("row_id", *columns)))
    folded = df.withColumn("part", F.floor(F.col("row_id") * parts / n)).groupBy("part").agg(items.alias("items"))
    return folded.select(F.col("part").alias("row_id"), *[F.transform("items", _field(c)).alias(c) for c in columns])


def take(df: DataFrame, index: list[int]) -> DataFrame:
    """The rows at index, in its order, as often as it names them; negative places count from the end, places that there aren't give no rows."""
    wanted = df.sparkSession.createDataFrame(list(enumerate(index)), "new_id long, __at long")
    if any(i < 0 for i in index):
        wanted = wanted.withColumn("__at", F.when(F.col("__at") < 0, F.col("__at") + size_of(df)).otherwise(F.col("__at")))
    return df.join(wanted, F.col("row_id") == F.col("__at")).drop("row_id", "__at").withColumnRenamed("new_id", "row_id")


def where_mask(df: DataFrame, mask: Column) -> DataFrame:
    return renumber(df.where(mask))


def renumber(df: DataFrame) -> DataFrame:
    return with_row_id(df.withColumnRenamed("row_id", "__old"), "__old").drop("__old")


def slice_rows(df: DataFrame, start: int | None, stop: int | None, step: int | None = None) -> DataFrame:
    """Rows start:stop:step as Python counts them: negative bounds from the end, and backwards with a negative step."""
    step = 1 if step is None else step
    if step == 0:
        raise ValueError("a slice's step is not 0")
    n = size_of(df)
    least, most = (F.lit(0), n) if step > 0 else (F.lit(-1), n - 1)

    def bound(x: int | None, default: Column) -> Column:
        if x is None:
            return default
        return F.least(F.lit(x), most) if x >= 0 else F.greatest(n + F.lit(x), least)

    first, last = bound(start, least if step > 0 else most), bound(stop, most if step > 0 else least)
    far = (F.col("row_id") - first) * (1 if step > 0 else -1)
    inside = F.col("row_id") < last if step > 0 else F.col("row_id") > last
    kept = df.where((far >= 0) & inside & (far % abs(step) == 0))
    return kept.withColumn("row_id", F.floor(far / abs(step)).cast("long"))


def get_rows(df: DataFrame, item: int | slice | list | np.ndarray | Column) -> DataFrame:
    """One row (which there must be), a slice, the rows of a list of places or of flags, or those where a condition holds."""
    if isinstance(item, Column):
        return where_mask(df, item)
    if isinstance(item, slice):
        return slice_rows(df, item.start, item.stop, item.step)
    if isinstance(item, (int, np.integer)) and not isinstance(item, bool):
        found = take(df, [int(item)])
        if found.isEmpty():
            raise IndexError(f"no row {item}")
        return found
    if isinstance(item, (list, np.ndarray)):
        listed = np.asarray(item).tolist()
        if listed and all(isinstance(x, bool) for x in listed):
            listed = [i for i, x in enumerate(listed) if x]
        return take(df, listed)
    raise TypeError(f"rows can't be told by {type(item).__name__}")


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """a with b's columns, row by row. Both have the same rows; a column of both must hold equal values."""
    common = [c for c in a.columns if c in b.columns and c != "row_id"]
    right = b.withColumnsRenamed({c: f"__b_{c}" for c in common}).withColumn("__in_b", F.lit(True))
    joined = a.withColumn("__in_a", F.lit(True)).join(right, "row_id", "full")
    ok = F.col("__in_a").isNotNull() & F.col("__in_b").isNotNull()
    for c in common:
        ok = ok & F.col(c).eqNullSafe(F.col(f"__b_{c}"))
    checked = F.when(ok, F.col("row_id")).otherwise(F.raise_error("the batches differ in rows or in a common column"))
    return joined.withColumn("row_id", checked).drop("__in_a", "__in_b", *[f"__b_{c}" for c in common])


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """df as a table of the session's warehouse in buckets of row_id, each one sorted file. union_columns of such tables of equally many buckets
    joins file by file, without a shuffle. An existing table of that name raises."""
    df.repartition(buckets, "row_id").write.bucketBy(buckets, "row_id").sortBy("row_id").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def concat(*batches: DataFrame) -> DataFrame:
    """All rows of each batch after those of the one before."""
    out, before = batches[0], size_of(batches[0])
    for b in batches[1:]:
        out = out.unionByName(b.withColumn("row_id", F.col("row_id") + before))
        before = before + size_of(b)
    return out


def repeat(df: DataFrame, times: int, interleave: bool = True) -> DataFrame:
    """Each row times over: in place (a a b b) or batch after batch (a b a b). rollout_idx tells the copies apart."""
    many = df.withColumn("rollout_idx", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    new = F.col("row_id") * times + F.col("rollout_idx") if interleave else F.col("rollout_idx") * size_of(df) + F.col("row_id")
    return many.withColumn("row_id", new.cast("long"))


def chunk(df: DataFrame, chunks: int) -> DataFrame:
    """part for each row, in chunks equal parts; raises if they can't be equal."""
    n = size_of(df)
    part = F.floor(F.col("row_id") / (n / chunks))
    return df.withColumn("part", F.when(n % chunks == 0, part).otherwise(F.raise_error(f"rows can't be dealt to {chunks} equal chunks")).cast("long"))


def split(df: DataFrame, size: int) -> DataFrame:
    n = size_of(df)
    return df.withColumn("part", F.when(n % size == 0, F.floor(F.col("row_id") / size)).otherwise(F.raise_error(f"rows can't be split by {size}")).cast("long"))


def pad_to_multiple(df: DataFrame, divisor: int) -> DataFrame:
    """df and as many of its first rows again, round and round, as make a multiple; is_pad tells them."""
    n = size_of(df)
    need = (F.lit(divisor) - n % divisor) % divisor
    # Row i stands in for the places N + i, N + i + N, ... below N + need.
    extra = df.where(F.col("row_id") < need).withColumn("row_id", F.explode(F.sequence(F.col("row_id") + n, n + need - 1, n)))
    return df.withColumn("is_pad", F.lit(False)).unionByName(extra.withColumn("is_pad", F.lit(True)))


def unpad(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_pad")).drop("is_pad")


def batches(df: DataFrame, size: int, drop_last: bool) -> DataFrame:
    """batch_id for each row; with drop_last without the rows of a last batch that isn't full."""
    out = df.withColumn("batch_id", F.floor(F.col("row_id") / size).cast("long"))
    return out.where(F.col("batch_id") < F.floor(size_of(df) / size)) if drop_last else out


def _drawn(seed: int, *columns: str) -> Column:
    """A hash of columns and seed, by which rows are put in an order that seems random."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns], F.lit(str(seed))))


def epochs(df: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    """n passes in mini-batches of size, each pass in its own order."""
    many = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    placed = with_row_id(many.withColumn("__h", _drawn(seed, "row_id", "epoch")), "epoch", "__h", "row_id", name="__at")
    return placed.withColumn("batch_id", F.floor((F.col("__at") - F.col("epoch") * size_of(df)) / size).cast("long")).drop("__h", "__at")


def limit_rows(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("row_id") < n)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df in an order that depends on key and seed only."""
    return with_row_id(df.withColumn("__h", _drawn(seed, key)), "__h", key).drop("__h")


def sample_rows(df: DataFrame, text: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by a seeded hash of a text column."""
    return df.orderBy(_drawn(seed, text), text, "row_id").limit(n)


def reorder(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Row old goes to place new, by mapping (old, new)."""
    return df.join(mapping.withColumnRenamed("old", "row_id"), "row_id").drop("row_id").withColumnRenamed("new", "row_id")


def inverse(mapping: DataFrame) -> DataFrame:
    return mapping.select(F.col("new").alias("old"), F.col("old").alias("new"))


def explode_tokens(df: DataFrame, values: str, mask: str) -> DataFrame:
    """Valid tokens of all rows in long form: row_id, pos, the value."""
    both = df.select("row_id", F.posexplode(F.arrays_zip(values, mask)).alias("pos", "__x"))
    return both.where(F.col(f"__x.{mask}") > 0).select("row_id", "pos", F.col(f"__x.{values}").alias(values))


def gather_tokens(tokens: DataFrame, values: str) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct("pos", values)))
    return tokens.groupBy("row_id").agg(F.transform(items, lambda x: x[values]).alias(values))


def once_per_key(df: DataFrame, key: str, feature, columns: list[str], name: str) -> DataFrame:
    """df with a feature that is computed once for each key: feature is a function from columns to a column."""
    made = df.dropDuplicates([key]).select(key, feature(*columns).alias(name))
    return df.join(made, key)
