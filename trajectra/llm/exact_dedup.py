"""Exact deduplication by progressive refinement: length, then a hash of the first bytes, then a hash of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialise

#: Characters that the second round hashes.
PREFIX_CHARS = 256
#: Bits of a filter of keys: SPARE a key, at least and at most these powers of two (8 MB).
SPARE, LEAST_BITS, MOST_BITS = 16, 12, 26


def _filter(keys: DataFrame, key: str) -> Column:
    """A condition on a column of hashes of that name that holds for all of keys, and for few others: a bit map of bounded size,
    built by aggregation, as a scalar subquery. The more keys, the more others pass, which costs time and changes nothing."""
    wanted = max(1, SPARE * keys.count())
    bits = 1 << min(max(wanted - 1, 1).bit_length(), MOST_BITS)
    bits = max(bits, 1 << LEAST_BITS)
    at = F.pmod(F.col(key), F.lit(bits))
    word, bit = F.shiftright(at, 6).cast("int"), at.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = keys.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits"))
    # A row for each word of the map: as many as it has, whatever the table's size.
    whole = keys.sparkSession.range(0, bits >> 6).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    pairs = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))
    listed = whole.agg(F.transform(pairs, lambda x: x["bits"])).scalar()
    return F.get(listed, word).bitwiseAND(one) != 0


def _survivors(df: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> tuple[DataFrame, Column]:
    """df as row, id, text, n_bytes, and whether a row may have an equal: first lengths that occur again, then, of the rows that have one of these,
    hashes of length and first characters that occur again."""
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    rows = rows.withColumn("size", F.xxhash64("n_bytes"))
    sizes = materialise(rows.groupBy("size").count().where("count > 1").select("size"), "lengths")
    again = _filter(sizes, "size")
    rows = rows.withColumn("head", F.when(again, F.xxhash64("n_bytes", F.substring("text", 1, prefix_chars))))
    heads = materialise(rows.where("head is not null").groupBy("head").count().where("count > 1").select("head"), "heads")
    return rows, F.coalesce(_filter(heads, "head"), F.lit(False))


def exact_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Classes of two or more rows with equal texts: text_sha256, n_bytes, keep_id (largest id), group_size.

    Three rounds, each over the rows that the one before left: rows alone with their length in bytes drop out,
    then rows alone with length and hash of the first characters; only the rest has its full content hashed.
    A null text is an empty one. Null ids count as rows and are never kept before others. An empty table gives
    no class. Other columns are not read. Aggregations combine before they shuffle, so one class may hold any
    share of the rows.
    """
    rows, may = _survivors(df.select(F.col(id_col), F.col(text_col)), id_col, text_col, prefix_chars)
    return _classes(rows.where(may))


def _classes(rows: DataFrame) -> DataFrame:
    classes = rows.groupBy(F.sha2("text", 256).alias("text_sha256"), "n_bytes").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return classes.where("group_size > 1")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of df: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Rows that repeat id and text too are one group with the
    rest; of those with the kept id exactly one has kept = true. If all ids of a group are null, keep_id is null
    and one of its rows is kept. A null text is an empty one. An empty table gives an empty result.
    """
    classes = materialise(exact_duplicate_classes(df, id_col, text_col, prefix_chars), "classes")
    # A row that repeats id and text is told apart from its twins by a number; others have one row here.
    rows = df.select(F.col(id_col).alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"))
    rows = rows.groupBy("id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.lit(1)).count()
    joined = attach(rows, classes.drop("n_bytes"), ["text_sha256"], "group_size", total)
    joined = joined.withColumn("twin", F.explode(F.sequence(F.lit(1), F.col("n"))))
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), (F.col("id").eqNullSafe(keep) & (F.col("twin") == 1)).alias("kept"), "text_sha256")


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows that exact_dedup doesn't keep; all columns of df, in any order of rows.

    Rows that the first two rounds tell apart stay where they are; only the others are hashed whole and sent."""
    rows, may = _survivors(df, id_col, text_col, PREFIX_CHARS)
    apart, alike = rows.where(~may), rows.where(may)
    classes = materialise(_classes(alike), "classes")
    alike = alike.select("row", "id", F.sha2("text", 256).alias("text_sha256"))
    joined = attach(alike, classes.drop("n_bytes"), ["text_sha256"], "group_size", df.select(F.lit(1)).count())
    # Usually one of a class; of rows that repeat the id too any one.
    one = joined.where(F.col("group_size").isNotNull() & F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("text_sha256").agg(F.first("row").alias("row"))
    lone = joined.where("group_size is null")
    return apart.select("row.*").unionByName(lone.select("row.*")).unionByName(one.select("row.*"))
