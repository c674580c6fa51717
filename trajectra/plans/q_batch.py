"""The batch algebra on customers in order of their key, and length-balanced parts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import batch, partition
from ..operators.batch import size_of
from .views import sequences, table


def _customers(spark, d):
    return batch.with_row_id(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), "c_custkey")


def _suppliers(spark, d):
    return batch.with_row_id(table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal")), "c_custkey")


def _on(f):
    return lambda spark, d: f(_customers(spark, d))


def _pop(df):
    taken, rest = batch.pop_columns(df, ["c_name", "missing"])
    return batch.union_columns(taken, rest)


def _fold(df):
    """All rows, padded to a multiple of the parts."""
    out = batch.fold(batch.pad_to_multiple(df, 10), 10, ["c_custkey"])
    return out.select("row_id", F.array_join(F.transform("c_custkey", lambda x: x.cast("string")), ",").alias("keys"))


def _union(spark, d):
    orders = batch.with_row_id(table(spark, d, "orders"), "o_orderkey")
    return batch.union_columns(orders.select("row_id", "o_orderkey", "o_totalprice"), orders.select("row_id", "o_orderkey", "o_custkey"))


def _concat(spark, d):
    return batch.concat(_customers(spark, d), _suppliers(spark, d)).select("row_id", "c_name")


def _reorder(df):
    n = size_of(df)
    mapping = df.select(F.col("row_id").alias("old"), (n - 1 - F.col("row_id")).alias("new"))
    there = batch.reorder(df, mapping)
    return batch.reorder(there, batch.inverse(mapping)).select("row_id", "c_custkey")


def _unpad_tokens(spark, d):
    """Arrays to valid tokens and back."""
    flat = batch.explode_tokens(sequences(spark, d), "rewards", "mask")
    back = batch.gather_tokens(flat, "rewards")
    return back.select("row_id", F.size("rewards").cast("long").alias("n"), F.round(F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _documents(spark, d):
    """All documents, numbered densely, in batches of 256, the last of which may be short."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("length"))
    return batch.batches(batch.with_row_id(docs, "doc_id", "length"), 256, drop_last=False)


def _dealt(spark, d, by=partition.differencing):
    """A short last batch is dealt to at most as many parts as it has rows."""
    docs = _documents(spark, d)
    short = F.col("batch_id") == F.floor(size_of(docs) / 256)
    parts = partition.deal(docs.where(~short), 8, by=by).unionByName(partition.deal(docs.where(short), 8, equal_size=False, by=by))
    return docs.join(parts, ["batch_id", "row_id"])


def _balance(spark, d):
    """What each batch was dealt to. Parts of a full batch have equally many rows, and never differ by more than the widest of the
    groups that differencing starts from: eight rows of neighbouring lengths, in the short batch one row."""
    dealt = _dealt(spark, d)
    turn = F.row_number().over(Window.partitionBy("batch_id").orderBy("length", "row_id")) - 1
    full = F.count(F.lit(1)).over(Window.partitionBy("batch_id")) == 256
    seeds = dealt.select("batch_id", "length", full.alias("full"), F.when(full, F.floor(turn / 8)).otherwise(turn).alias("seed"))
    seeds = seeds.groupBy("batch_id", "full", "seed").agg((F.max("length") - F.when(F.col("full"), F.min("length")).otherwise(0)).alias("gap"))
    bounds = seeds.groupBy("batch_id").agg(F.max("gap").cast("long").alias("bound"))
    sums = dealt.groupBy("batch_id", "part").agg(F.sum("length").alias("chars"), F.count(F.lit(1)).alias("rows"))
    even = F.when(F.sum("rows") == 256, F.max("rows") == F.min("rows"))
    each = sums.groupBy("batch_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("chars").alias("chars"), even.alias("even"), (F.max("chars") - F.min("chars")).alias("spread"))
    return each.join(bounds, "batch_id").select("batch_id", "parts", "rows", "chars", "even", "bound", (F.col("spread") <= F.col("bound")).alias("within"))


def _lightest(spark, d):
    """Rows and lengths of each part."""
    return _dealt(spark, d, partition.lightest_bin).groupBy("batch_id", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("length").alias("chars"))


def _imbalance(spark, d):
    """Contiguous parts of each batch against those that it was dealt to, which in a full batch are never further apart."""
    dealt = _dealt(spark, d).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("batch_id")))
    out = partition.imbalance(dealt, 8).join(dealt.groupBy("batch_id").agg(F.max("__n").alias("rows")), "batch_id")
    closer = F.when(F.col("rows") == 256, (F.col("balanced_min") >= F.col("min")) & (F.col("balanced_max") <= F.col("max")))
    return out.select("batch_id", "min", "max", "minmax_diff", "mean", closer.alias("closer"))


def _micro(spark, d):
    """Of each batch how many parts there are, what they hold, and whether they stand in falling order of squared lengths."""
    docs = _documents(spark, d)
    rows = partition.micro_batches(docs, 100_000).join(docs, ["batch_id", "row_id"])
    parts = rows.groupBy("batch_id", "part", "turn").agg(F.sum(F.col("length").cast("double") * F.col("length")).alias("cost"), F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    above = F.lag("cost").over(Window.partitionBy("batch_id").orderBy("turn"))
    parts = parts.withColumn("falls", F.coalesce(above >= F.col("cost"), F.lit(True)))
    return parts.groupBy("batch_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.min("falls").alias("falls"))


def _given(spark, d):
    """The five regions as columns that the driver holds."""
    rows = table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()
    return batch.from_columns(spark, {"key": [r[0] for r in rows], "name": [r[1] for r in rows], "square": np.array([r[0] ** 2 for r in rows])}, {"key": "bigint", "square": "bigint"})


def _merged(spark, d):
    """The records of two tables as one row; the key that both have must agree."""
    record = lambda name, key: table(spark, d, name).agg(F.count(F.lit(1)).alias(f"{name}_rows"), F.max(key).alias(f"{name}_top"), F.lit(3).alias("step")).first().asDict()
    out = batch.merge_records(record("region", "r_regionkey"), record("nation", "n_nationkey"))
    return spark.createDataFrame([tuple(out.values())], ", ".join(f"{k} bigint" for k in out))


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")

QUERIES = {
    "q_row_id": _on(lambda c: c.select("row_id", "c_custkey")),
    "q_select_columns": _on(lambda c: batch.select_columns(c, ["c_name", "missing"])),
    "q_pop": _on(_pop),
    "q_rename": _on(lambda c: batch.rename_columns(c, ["c_name"], ["name"]).select("row_id", "name")),
    "q_prompt_uid": _on(lambda c: c.select("c_custkey", batch.prompt_uid("c_name").alias("uid"))),
    "q_fold": _on(_fold),
    "q_take": _on(lambda c: batch.take(c, [5, 3, 3, 0, 99]).select("row_id", "c_custkey")),
    "q_mask": _on(lambda c: batch.where_mask(c, F.col("c_acctbal") > 0).select("row_id", "c_custkey")),
    "q_slice": _on(lambda c: batch.slice_rows(c, -100, -3, 7).select("row_id", "c_custkey")),
    "q_union_columns": _union,
    "q_concat": _concat,
    "q_repeat": _on(lambda c: batch.repeat(c, 3).select("row_id", "c_custkey", "rollout_idx")),
    "q_tile": _on(lambda c: batch.repeat(c, 3, interleave=False).select("row_id", "c_custkey", "rollout_idx")),
    "q_chunk": _on(lambda c: batch.chunk(c, 10).select("row_id", "part")),
    "q_split": _on(lambda c: batch.split(c, 50).select("row_id", "part")),
    "q_pad": _on(lambda c: batch.pad_to_multiple(c, 64).select("row_id", "c_custkey", "is_pad")),
    "q_pad_wraps": lambda spark, d: batch.pad_to_multiple(batch.with_row_id(table(spark, d, "region"), "r_regionkey"), 16).select("row_id", "r_regionkey", "is_pad"),
    "q_unpad": _on(lambda c: batch.unpad(batch.pad_to_multiple(c, 64)).select("row_id", "c_custkey")),
    "q_batches": _on(lambda c: batch.batches(c, 64, drop_last=True).select("row_id", "batch_id")),
    "q_batches_all": _on(lambda c: batch.batches(c, 64, drop_last=False).select("row_id", "batch_id")),
    "q_limit_rows": _on(lambda c: batch.limit_rows(c, 77).select("row_id", "c_custkey")),
    "q_reorder_restore": _on(_reorder),
    "q_shard": _on(lambda c: partition.shard(c, 4, 3).select("row_id", "c_custkey")),
    "q_unpad_tokens": _unpad_tokens,
    "q_shuffle": _on(lambda c: batch.shuffled(c.drop("row_id"), "c_custkey", 7).select("row_id", "c_custkey")),
    "q_epochs": _on(lambda c: batch.epochs(c, 2, 32, 1).select("row_id", "epoch", "batch_id")),
    "q_sample": lambda spark, d: batch.sample_rows(table(spark, d, "documents").withColumnRenamed("doc_id", "row_id"), "text", 10).select("row_id"),
    "q_balance": _balance,
    "q_lightest_bin": _lightest,
    "q_imbalance": _imbalance,
    "q_micro_batches": _micro,
    "q_from_columns": _given,
    "q_merge_records": _merged,
    "q_checked_lengths": lambda spark, d: batch.checked_lengths(sequences(spark, d), ["rewards", "values", "mask"]).select("row_id", F.size("mask").alias("n")),
    "q_row_ids_lines": lambda spark, d: batch.with_row_id(table(spark, d, "lineitem"), *_LINE).select("row_id", *_LINE),
    "q_slice_back": _on(lambda c: batch.get_rows(c, slice(-5, 10, -3)).select("row_id", "c_custkey")),
    "q_get_flags": _on(lambda c: batch.get_rows(c, [True, False, True, True]).select("row_id", "c_custkey")),
    "q_get_row": _on(lambda c: batch.get_rows(c, -1).select("row_id", "c_custkey")),
    "q_get_where": _on(lambda c: batch.get_rows(c, F.col("c_acctbal") < 0).select("row_id", "c_custkey")),
    "q_once_per_key": lambda spark, d: batch.once_per_key(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", lambda c: F.col(c) % 10, ["o_custkey"], "digit"),
}

_C = "c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey, c_name, c_acctbal FROM customer), n AS (SELECT count(*) AS n FROM customer)"
_B = "b AS (SELECT row_id, row_id // 256 AS batch_id, length FROM (SELECT row_number() OVER (ORDER BY doc_id, length) - 1 AS row_id, length FROM (SELECT doc_id, coalesce(n_chars, 0) AS length FROM documents)))"

SQL = {
    "q_row_id": f"WITH {_C} SELECT row_id, c_custkey FROM c",
    "q_select_columns": f"WITH {_C} SELECT row_id, c_name FROM c",
    "q_pop": f"WITH {_C} SELECT * FROM c",
    "q_rename": f"WITH {_C} SELECT row_id, c_name AS name FROM c",
    "q_prompt_uid": "SELECT c_custkey, sha256(c_name) AS uid FROM customer",
    "q_fold": f"WITH {_C}, m AS (SELECT (10 - n % 10) % 10 AS p, (n + 9) // 10 AS size FROM n), a AS (SELECT row_id, c_custkey FROM c UNION ALL SELECT row_id + n, c_custkey FROM c, n, m WHERE row_id < p) SELECT row_id // size AS row_id, string_agg(c_custkey::VARCHAR, ',' ORDER BY row_id) AS keys FROM a, m GROUP BY 1",
    "q_take": f"WITH {_C}, i AS (SELECT unnest([5, 3, 3, 0, 99]) AS j, unnest([0, 1, 2, 3, 4]) AS k) SELECT k::BIGINT AS row_id, c_custkey FROM i JOIN c ON c.row_id = j",
    "q_mask": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey FROM customer WHERE c_acctbal > 0",
    "q_slice": f"WITH {_C} SELECT (row_id - (n - 100)) // 7 AS row_id, c_custkey FROM c, n WHERE row_id >= n - 100 AND row_id < n - 3 AND (row_id - (n - 100)) % 7 = 0",
    "q_union_columns": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, o_totalprice, o_custkey FROM orders",
    "q_concat": f"WITH {_C} SELECT row_id, c_name FROM c UNION ALL SELECT row_number() OVER (ORDER BY s_suppkey) - 1 + n, s_name FROM supplier, n",
    "q_repeat": f"WITH {_C} SELECT row_id * 3 + k AS row_id, c_custkey, k::INT AS rollout_idx FROM c, generate_series(0, 2) AS g(k)",
    "q_tile": f"WITH {_C} SELECT k * n + row_id AS row_id, c_custkey, k::INT AS rollout_idx FROM c, n, generate_series(0, 2) AS g(k)",
    "q_chunk": f"WITH {_C} SELECT row_id, row_id // (n // 10) AS part FROM c, n",
    "q_split": f"WITH {_C} SELECT row_id, row_id // 50 AS part FROM c",
    "q_pad": f"WITH {_C}, m AS (SELECT (64 - n % 64) % 64 AS p FROM n) SELECT row_id, c_custkey, false AS is_pad FROM c UNION ALL SELECT row_id + n, c_custkey, true FROM c, n, m WHERE row_id < p",
    "q_pad_wraps": "SELECT g.i AS row_id, r_regionkey, g.i >= 5 AS is_pad FROM generate_series(0, 15) AS g(i) JOIN region ON r_regionkey = g.i % 5",
    "q_unpad": f"WITH {_C} SELECT row_id, c_custkey FROM c",
    "q_batches": f"WITH {_C} SELECT row_id, row_id // 64 AS batch_id FROM c, n WHERE row_id // 64 < n // 64",
    "q_batches_all": f"WITH {_C} SELECT row_id, row_id // 64 AS batch_id FROM c",
    "q_limit_rows": f"WITH {_C} SELECT row_id, c_custkey FROM c WHERE row_id < 77",
    "q_reorder_restore": f"WITH {_C} SELECT row_id, c_custkey FROM c",
    "q_shard": f"WITH {_C}, p AS (SELECT ceil(n / 4)::BIGINT AS size FROM n) SELECT g.i AS row_id, c_custkey FROM n, p, generate_series(0, 1000000) AS g(i) JOIN c ON c.row_id = g.i % (SELECT n FROM n) WHERE g.i >= 3 * size AND g.i < 4 * size",
    "q_unpad_tokens": "SELECT user_id AS row_id, count(*) AS n, round(sum(value / 97), 6) AS total FROM events WHERE event_type <> 'error' GROUP BY user_id",
    "q_once_per_key": "SELECT o_orderkey, o_custkey, o_custkey % 10 AS digit FROM orders",
    "q_shuffle": "SELECT row_number() OVER (ORDER BY md5(c_custkey::VARCHAR || ':7'), c_custkey) - 1 AS row_id, c_custkey FROM customer",
    "q_epochs": f"WITH {_C} SELECT row_id, e::INT AS epoch, (row_number() OVER (PARTITION BY e ORDER BY md5(row_id || ':' || e || ':1'), row_id) - 1) // 32 AS batch_id FROM c, generate_series(0, 1) AS g(e)",
    "q_sample": "SELECT doc_id AS row_id FROM documents ORDER BY md5(coalesce(text, '') || ':42'), text NULLS FIRST, doc_id LIMIT 10",
    "q_balance": f"""
WITH {_B}, t AS (SELECT batch_id, length, count(*) OVER (PARTITION BY batch_id) = 256 AS whole, row_number() OVER (PARTITION BY batch_id ORDER BY length, row_id) - 1 AS turn FROM b),
g AS (SELECT batch_id, max(length) - CASE WHEN whole THEN min(length) ELSE 0 END AS gap FROM t GROUP BY batch_id, whole, CASE WHEN whole THEN turn // 8 ELSE turn END),
m AS (SELECT batch_id, max(gap)::BIGINT AS bound FROM g GROUP BY batch_id)
SELECT batch_id, least(8, count(*)) AS parts, count(*) AS rows, sum(length)::BIGINT AS chars, CASE WHEN count(*) = 256 THEN true END AS even, any_value(bound) AS bound, true AS within FROM b JOIN m USING (batch_id) GROUP BY batch_id""",
    "q_lightest_bin": f"""
WITH RECURSIVE {_B}, s AS (SELECT batch_id, least(8, count(*)) AS k, CASE WHEN count(*) = 256 THEN sum(length)::BIGINT + 1 ELSE 0 END AS bias FROM b GROUP BY batch_id),
walk AS (
  SELECT batch_id, batch_id * 256 AS row_id, bias, list_transform(range(k), lambda x: 0::BIGINT) AS w, 0::BIGINT AS part, 0::BIGINT AS length FROM s
  UNION ALL
  SELECT batch_id, row_id + 1, bias, list_transform(w, lambda x, j: CASE WHEN j = p THEN x + n + bias ELSE x END), p - 1, n
  FROM (SELECT walk.batch_id, walk.row_id, bias, w, list_position(w, list_min(w))::BIGINT AS p, b.length::BIGINT AS n FROM walk JOIN b ON b.batch_id = walk.batch_id AND b.row_id = walk.row_id)
)
SELECT batch_id, part, count(*) AS rows, sum(length)::BIGINT AS chars FROM walk WHERE row_id > batch_id * 256 GROUP BY batch_id, part""",
    "q_imbalance": f"WITH {_B}, c AS (SELECT *, count(*) OVER (PARTITION BY batch_id) AS n FROM b), p AS (SELECT batch_id, n, least((row_id % 256) // greatest(n // 8, 1), 7) AS p, sum(length)::BIGINT AS s FROM c GROUP BY ALL) SELECT batch_id, min(s) AS min, max(s) AS max, max(s) - min(s) AS minmax_diff, sum(s) / 8 AS mean, CASE WHEN n = 256 THEN true END AS closer FROM p GROUP BY batch_id, n",
    "q_micro_batches": f"WITH {_B} SELECT batch_id, least(count(*), greatest(1, ceil(sum(length) / 100000)))::BIGINT AS parts, count(*) AS rows, sum(length)::BIGINT AS tokens, true AS falls FROM b GROUP BY batch_id",
    "q_from_columns": "SELECT r_regionkey::BIGINT AS row_id, r_regionkey::BIGINT AS key, r_name AS name, (r_regionkey * r_regionkey)::BIGINT AS square FROM region",
    "q_merge_records": "SELECT (SELECT count(*) FROM region) AS region_rows, (SELECT max(r_regionkey) FROM region)::BIGINT AS region_top, 3::BIGINT AS step, (SELECT count(*) FROM nation) AS nation_rows, (SELECT max(n_nationkey) FROM nation)::BIGINT AS nation_top",
    "q_checked_lengths": "SELECT user_id AS row_id, count(*)::INT AS n FROM events GROUP BY user_id",
    "q_row_ids_lines": f"SELECT row_number() OVER (ORDER BY {', '.join(_LINE)}) - 1 AS row_id, {', '.join(_LINE)} FROM lineitem",
    "q_slice_back": f"WITH {_C} SELECT (n - 5 - row_id) // 3 AS row_id, c_custkey FROM c, n WHERE row_id <= n - 5 AND row_id > 10 AND (n - 5 - row_id) % 3 = 0",
    "q_get_flags": f"WITH {_C} SELECT CASE row_id WHEN 0 THEN 0 ELSE row_id - 1 END AS row_id, c_custkey FROM c WHERE row_id IN (0, 2, 3)",
    "q_get_row": f"WITH {_C} SELECT 0::BIGINT AS row_id, c_custkey FROM c, n WHERE row_id = n - 1",
    "q_get_where": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey FROM customer WHERE c_acctbal < 0",
}
