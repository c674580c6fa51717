"""Reading back what the sinks write, user functions, and the streaming forms, run to their end on a table's rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import advantage, curriculum, kl
from ..operators.batch import bucketed, union_columns, with_row_id
from ..runtime import new_folder
from ..sources import epochs, prompts, sinks
from ..streaming.accumulate import Accumulator, accumulate, best_scores, controlled_coefficients
from ..streaming.collect import collect_groups, keyed_state
from . import registry, rules
from .views import TRAJ, rounded, table, trajectories


def _json_round_trip(spark, d):
    at = new_folder(spark)
    rows = table(spark, d, "nation").select(F.col("n_name").alias("question"), F.lit("é").alias("answer"), F.when(F.col("n_regionkey") > 1, F.col("n_name")).alias("source"))
    sinks.write_json_lines(rows, f"{at}/train")
    lines = spark.read.text(f"{at}/train")
    return lines.select(F.get_json_object("value", "$.question").alias("question"), F.get_json_object("value", "$.answer").alias("answer"), F.col("value").contains("source").alias("has_source"))


def _json_array(spark, d):
    """The files of the array, joined, are read as one JSON text."""
    at = new_folder(spark)
    rows = with_row_id(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("question"), F.when(F.col("n_regionkey") > 1, F.lit("é")).alias("source")), "n_nationkey")
    sinks.write_json_array(rows, f"{at}/val", "row_id")
    whole = spark.read.text(f"{at}/val").withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file", "at", "value"))), lambda x: x["value"]), "\n")
    parsed = whole.agg(F.from_json(text, "array<struct<n_nationkey:int,question:string,source:string>>").alias("rows"))
    return parsed.select(F.inline("rows"))


def _splits(spark, d):
    """A table with a split column, a folder with a split in a folder of its own, and a table without splits."""
    at = new_folder(spark)
    orders = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "test").when(F.col("o_orderkey") % 10 == 1, F.lit(None)).otherwise("train").alias("split"))
    orders.write.parquet(f"{at}/orders.parquet")
    orders.where("split = 'test'").drop("split").write.parquet(f"{at}/apart/val.parquet")
    orders.where("split = 'train'").drop("split").write.parquet(f"{at}/apart/train.parquet")
    out = None
    for path in ("orders.parquet", "orders.parquet@test", "apart", "apart@val", "apart/train.parquet@train"):
        part = prompts.read_table(spark, f"{at}/{path}").select(F.lit(path).alias("path"), "o_orderkey")
        out = part if out is None else out.unionByName(part)
    return out


def _validation_sets(spark, d):
    both = prompts.validation_sets(spark, [f"{d}/region.parquet", "", f"{d}/nation.parquet"])
    return both.select("val_name", "r_name", "n_nationkey", "n_name")


def _checkpoint(spark, d):
    at = new_folder(spark)
    state = table(spark, d, "region").select(F.col("r_regionkey").alias("k"))
    for step, score in ((10, 0.51236), (20, 0.4)):
        sinks.save_checkpoint(state, at, step, 10, score)
    path, found = sinks.latest_checkpoint(spark, at)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.lit(found["last_global_step"]).alias("step"), F.lit(found["best_global_step"]).alias("best"), F.lit(found["best_val_reward_score"]).alias("score"))


def _row_rule(spark, d):
    t = trajectories(spark, d).select("row_id", "acc", "fmt")
    return rounded(registry.score_rows(t, lambda r: {"overall": r["acc"] + 0.1 * r["fmt"]}, ["acc", "fmt"], ["overall"]), "row_id", "overall")


def _batch_rule(spark, d):
    def rule(rows):
        best = max(r["len"] for r in rows)
        return [{"share": r["len"] / best} for r in rows]

    t = trajectories(spark, d).select("row_id", "len", F.col("uid").alias("batch_id"))
    return rounded(registry.score_batches(t, rule, ["len"], ["share"]), "row_id", "share")


def _file_rule(spark, d):
    """A rule from a file, by path.py:function."""
    return rounded(registry.load_function(f"{rules.__file__}:doubled")(trajectories(spark, d)), "row_id", "overall")


def _estimator(spark, d):
    """An estimator that is registered by name: reward less the largest of its group."""
    if "less_best" not in advantage.ESTIMATORS:

        @advantage.register_estimator("less_best")
        def less_best(df, score="score", group="uid"):
            return df.withColumn("advantage", F.col(score) - F.max(score).over(Window.partitionBy(group)))

    return rounded(advantage.advantage("less_best", trajectories(spark, d), score="len"), "row_id", "advantage")


def _chunk_totals(spark, d):
    """A function that needs its chunk whole: each row's share of its chunk."""
    rows = with_row_id(table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("price")), "o_orderkey")
    out = registry.on_chunks(rows, lambda c: c.assign(share=c["price"] / c["price"].sum(), at=range(len(c)))[["o_orderkey", "share", "at"]], "o_orderkey long, share double, at long", 8)
    return rounded(out, "o_orderkey", "share", "at", digits=9)


def _given_chunks(spark, d):
    """Chunks by user, that the caller has dealt: only what the function makes of each comes back."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("row_id"), "user_id", "value")
    return rounded(registry.on_given_chunks(rows, lambda c: pd.DataFrame({"user_id": c["user_id"][:1], "first": c["value"][:1], "n": [len(c)]}), "user_id long, first double, n long", "user_id"), "user_id", "first", "n")


def _stream(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


def _accumulated(spark, d):
    """Groups in the band from a stream of mini-batches, up to a target."""
    at = new_folder(spark)
    rows = _stream(spark, d).select(F.col("event_id").alias("row_id"), F.floor(F.col("event_id") / 8).alias("uid"), (F.col("event_type") == "purchase").cast("double").alias("acc"))
    accumulate(rows, Accumulator(f"{at}/kept", 30, low=0.05, high=0.6), f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/kept").select("row_id", "uid")


def _controlled(make):
    def run(spark, d):
        """A controller over all events, a run a user and a step an event, with its values."""
        at = new_folder(spark)
        acc = F.coalesce(F.col("event_type") == "purchase", F.lit(False)).cast("double")
        rows = _stream(spark, d).select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("step"), (F.col("value") / 1000).alias("kl"), F.lit(100).alias("n"), F.when(F.col("event_type") != "error", acc).alias("acc"))
        query = controlled_coefficients(rows, make()).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return rounded(spark.read.parquet(f"{at}/out"), "run", "step", "used", "next")

    return run


def _collected(spark, d):
    """Batches of five groups in the band, of three runs, from mini-batches of all events."""
    at = new_folder(spark)
    group = F.floor(F.col("event_id") / 8)
    rows = _stream(spark, d).select((group % 3).alias("run"), F.floor(F.col("event_id") / 512).alias("mini"), F.lpad(group.cast("string"), 12, "0").alias("uid"), (F.col("event_type") == "purchase").cast("double").alias("acc"))
    with keyed_state(spark):
        query = collect_groups(rows, 5, 0.05, 0.6).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema("run string, step long, place long, uid string, tries long").parquet(f"{at}/out").withColumn("uid", F.col("uid").cast("long"))


def _customers(spark, d):
    return with_row_id(table(spark, d, "customer").select("c_custkey"), "c_custkey")


def _epoch_stream(spark, d):
    """Two shuffled epochs of all customers as a stream of three mini-batches each, joined with the table by row number."""
    at, rows = new_folder(spark), _customers(spark, d)
    n = rows.count()
    stream = epochs.mini_batches(spark, n, max(1, -(-n // 3)), 11, epochs=2, drop_last=False)
    query = stream.join(rows, "row_id").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(stream.join(rows, "row_id").schema).parquet(f"{at}/out").select("epoch", "place", "mini", "c_custkey")


def _shuffled_epochs(spark, d):
    return epochs.shuffled_epochs(_customers(spark, d), 2, 64, 11).select("epoch", "place", "mini", "c_custkey")


def _zipped(spark, d):
    """Columns of all orders put together again from two bucketed tables, without a shuffle."""
    rows, name = with_row_id(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), "o_orderkey"), f"zip_{spark.sql('select uuid()').first()[0].replace('-', '')}"
    a, b = bucketed(rows.drop("o_custkey"), f"{name}_a", 8), bucketed(rows.drop("o_totalprice"), f"{name}_b", 8)
    return union_columns(a, b)


def _stream_best(spark, d):
    """The best score of each set, as a running maximum of a stream."""
    at = new_folder(spark)
    rows = _stream(spark, d).select(F.col("event_type").alias("val_name"), F.col("value").alias("score"))
    query = best_scores(rows).writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/best")).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return rounded(spark.read.parquet(f"{at}/best"), "val_name", "best")


QUERIES = {
    "q_read_split": lambda spark, d: prompts.read_table(spark, f"{d}/nation.parquet").select("n_nationkey", "n_name"),
    "q_validation_sets": _validation_sets,
    "q_json_round_trip": _json_round_trip,
    "q_checkpoint": _checkpoint,
    "q_row_rule": _row_rule,
    "q_batch_rule": _batch_rule,
    "q_splits": _splits,
    "q_json_array": _json_array,
    "q_file_rule": _file_rule,
    "q_estimator": _estimator,
    "q_chunk_totals": _chunk_totals,
    "q_given_chunks": _given_chunks,
    "q_on_chunks": lambda spark, d: registry.on_chunks(trajectories(spark, d).select("row_id", "len"), lambda rows: rows.assign(len=rows["len"] * 2), "row_id long, len double", 8),
    "q_keep_rows": lambda spark, d: registry.keep_rows(trajectories(spark, d).select("row_id", "len"), lambda x: x > 100, "len"),
    "q_stream_accumulate": _accumulated,
    "q_stream_coefficients": _controlled(lambda: kl.controller("accuracy_based", 0.05, low=0.001, high=0.1)),
    "q_stream_adaptive": _controlled(lambda: kl.controller("adaptive", 0.05, target=0.05, horizon=10_000)),
    "q_stream_fixed": _controlled(lambda: kl.controller("fixed", 0.05)),
    "q_stream_best": _stream_best,
    "q_stream_groups": _collected,
    "q_epoch_stream": _epoch_stream,
    "q_shuffled_epochs": _shuffled_epochs,
    "q_zip_bucketed": _zipped,
    "q_named_rule": lambda spark, d: rounded(registry.load_function("answer")(trajectories(spark, d)), "row_id", "overall"),
    "q_make_batch": lambda spark, d: curriculum.make_batch(trajectories(spark, d), 10, 0.05, 0.6).select("row_id", "uid"),
}

_BAND = "kept AS (SELECT uid FROM traj GROUP BY uid HAVING avg(acc) > 0.05 AND avg(acc) < 0.6)"
_STEPS = "s AS (SELECT user_id::VARCHAR AS run, event_id AS step, value / 1000 AS kl, CASE WHEN event_type <> 'error' THEN CAST(event_type = 'purchase' AS DOUBLE) END AS acc FROM events)"

_HASH = "('0x' || substr(md5('11:' || e || ':{k}:' || {half}), 1, 8))::BIGINT"


def _epochs_sql(size):
    """The rows at all places of two epochs: four rounds backwards on (l, r), again for what falls outside."""
    left, right = (lambda k: f"((l - {_HASH.format(k=k, half='r')}) % a + a) % a"), (lambda k: f"((r - {_HASH.format(k=k, half='l')}) % b + b) % b")
    steps = "SELECT e, place, n, a, b, x // b AS l, x % b AS r FROM walk WHERE x >= n OR fresh"
    for k in (3, 2, 1, 0):
        steps = f"SELECT e, place, n, a, b, {left(k) if k % 2 == 0 else 'l'} AS l, {right(k) if k % 2 else 'r'} AS r FROM ({steps})"
    return f"""
WITH RECURSIVE c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey FROM customer),
s AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS b FROM customer),
walk AS (
  SELECT e, row_id AS place, n, a, b, row_id AS x, true AS fresh FROM c, s, generate_series(0, 1) AS g(e)
  UNION ALL
  SELECT e, place, n, a, b, l * b + r, false FROM ({steps})
)
SELECT e::INT AS epoch, place, place // {size} AS mini, c_custkey FROM walk JOIN c ON x = row_id WHERE NOT fresh AND x < n"""


SQL = {
    "q_stream_groups": """
WITH RECURSIVE g AS (SELECT (event_id // 8) % 3 AS run, event_id // 512 AS mini, event_id // 8 AS uid, avg(CAST(event_type = 'purchase' AS DOUBLE)) AS mean FROM events GROUP BY ALL),
m AS (SELECT run, mini, row_number() OVER (PARTITION BY run ORDER BY mini) AS i, count(*) FILTER (mean > 0.05 AND mean < 0.6) AS k FROM g GROUP BY run, mini),
walk AS (
  SELECT DISTINCT run, 0::BIGINT AS i, 0::BIGINT AS held, 0::BIGINT AS step, 0::BIGINT AS tries FROM m
  UNION ALL
  SELECT m.run, m.i, CASE WHEN held + k >= 5 THEN 0 ELSE held + k END, step + CAST(held + k >= 5 AS BIGINT), CASE WHEN held + k >= 5 THEN 0 ELSE tries + 1 END
  FROM walk w JOIN m ON m.run = w.run AND m.i = w.i + 1
),
ends AS (SELECT w.run, w.step, w.tries + 1 AS tries FROM walk w JOIN walk x ON x.run = w.run AND x.i = w.i + 1 AND x.step = w.step + 1),
kept AS (SELECT run, mini, uid, row_number() OVER (PARTITION BY run, mini ORDER BY uid) AS r FROM g WHERE mean > 0.05 AND mean < 0.6)
SELECT kept.run::VARCHAR AS run, w.step, w.held + r - 1 AS place, uid, ends.tries
FROM kept JOIN m ON m.run = kept.run AND m.mini = kept.mini JOIN walk w ON w.run = m.run AND w.i = m.i - 1 JOIN ends ON ends.run = w.run AND ends.step = w.step
WHERE w.held + r <= 5""",
    "q_epoch_stream": _epochs_sql("greatest(1, (n + 2) // 3)"),
    "q_shuffled_epochs": _epochs_sql("64"),
    "q_zip_bucketed": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, o_totalprice, o_custkey FROM orders",
    "q_read_split": "SELECT n_nationkey, n_name FROM nation",
    "q_validation_sets": "SELECT 'val_set_0' AS val_name, r_name, NULL::INT AS n_nationkey, NULL::VARCHAR AS n_name FROM region UNION ALL SELECT 'val_set_2', NULL, n_nationkey, n_name FROM nation",
    "q_json_array": "SELECT n_nationkey, n_name AS question, CASE WHEN n_regionkey > 1 THEN 'é' END AS source FROM nation",
    "q_splits": "WITH o AS (SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN NULL ELSE 'train' END AS split FROM orders) SELECT 'orders.parquet' AS path, o_orderkey FROM o WHERE coalesce(split, 'train') = 'train' UNION ALL SELECT 'orders.parquet@test', o_orderkey FROM o WHERE split = 'test' UNION ALL SELECT 'apart@val', o_orderkey FROM o WHERE split = 'test' UNION ALL SELECT p, o_orderkey FROM o, (SELECT unnest(['apart', 'apart/train.parquet@train']) AS p) WHERE split = 'train'",
    "q_file_rule": f"WITH {TRAJ} SELECT row_id, round(acc * 2 + fmt, 6) AS overall FROM traj",
    "q_estimator": f"WITH {TRAJ} SELECT row_id, round(len - max(len) OVER (PARTITION BY uid), 6) + 0.0 AS advantage FROM traj",
    "q_chunk_totals": "WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderkey, o_totalprice::DOUBLE AS price, count(*) OVER () AS n FROM orders), c AS (SELECT *, row_id * 8 // n AS part FROM o) SELECT o_orderkey, round(price / sum(price) OVER (PARTITION BY part), 9) AS share, row_number() OVER (PARTITION BY part ORDER BY row_id) - 1 AS at FROM c",
    "q_given_chunks": "SELECT user_id, round(min_by(value, event_id), 6) AS first, count(*) AS n FROM events GROUP BY user_id",
    "q_json_round_trip": "SELECT n_name AS question, 'é' AS answer, n_regionkey > 1 AS has_source FROM nation",
    "q_checkpoint": "SELECT count(*) AS rows, 20 AS step, 10 AS best, 0.4::DOUBLE AS score FROM region",
    "q_row_rule": f"WITH {TRAJ} SELECT row_id, round(acc + 0.1 * fmt, 6) AS overall FROM traj",
    "q_batch_rule": f"WITH {TRAJ} SELECT row_id, round(len / max(len) OVER (PARTITION BY uid), 6) AS share FROM traj",
    "q_on_chunks": f"WITH {TRAJ} SELECT row_id, len * 2 AS len FROM traj",
    "q_keep_rows": f"WITH {TRAJ} SELECT row_id, len FROM traj WHERE len > 100",
    "q_stream_accumulate": f"WITH {TRAJ}, {_BAND}, turn AS (SELECT uid FROM kept ORDER BY uid LIMIT 30) SELECT row_id, uid FROM traj WHERE uid IN (SELECT uid FROM turn)",
    "q_stream_coefficients": f"WITH {_STEPS}, b AS (SELECT *, last_value(0.001::DOUBLE + 0.099::DOUBLE * (1.0 - acc) IGNORE NULLS) OVER (PARTITION BY run ORDER BY step) AS after FROM s) SELECT run, step, round(coalesce(lag(after) OVER (PARTITION BY run ORDER BY step), 0.05::DOUBLE), 6) AS used, round(coalesce(after, 0.05::DOUBLE), 6) AS next FROM b",
    "q_stream_adaptive": f"WITH {_STEPS}, b AS (SELECT *, 0.05::DOUBLE * exp(sum(ln(1 + least(greatest(kl / 0.05 - 1, -0.2), 0.2) / 100)) OVER (PARTITION BY run ORDER BY step)) AS after FROM s) SELECT run, step, round(coalesce(lag(after) OVER (PARTITION BY run ORDER BY step), 0.05::DOUBLE), 6) AS used, round(after, 6) AS next FROM b",
    "q_stream_fixed": f"WITH {_STEPS} SELECT run, step, 0.05::DOUBLE AS used, 0.05::DOUBLE AS next FROM s",
    "q_stream_best": "SELECT event_type AS val_name, round(max(value), 6) AS best FROM events GROUP BY 1",
    "q_named_rule": f"WITH {TRAJ} SELECT row_id, round(acc + 0.1 * fmt, 6) AS overall FROM traj",
    "q_make_batch": f"WITH {TRAJ}, {_BAND}, turn AS (SELECT uid FROM kept ORDER BY uid LIMIT 10) SELECT row_id, uid FROM traj WHERE uid IN (SELECT uid FROM turn)",
}
