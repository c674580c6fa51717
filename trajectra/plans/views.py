"""Trajectories derived from the tables at hand, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import format_score


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", k.alias("k"))


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, uid (groups of 8 rows), user, acc, fmt, mar, len."""
    e = events(spark, sf_dir)
    response = F.concat(F.lit("<think>"), F.col("event_type"), F.lit("</think> "), F.when(F.col("user_id") % 2 == 0, F.lit("\\boxed{1}")).otherwise(F.lit("")))
    return e.select(
        F.col("event_id").alias("row_id"),
        F.floor(F.col("event_id") / 8).alias("uid"),
        F.col("user_id").alias("user"),
        (F.col("event_type") == "purchase").cast("double").alias("acc"),
        format_score(response).alias("fmt"),
        (F.col("k") / 100).alias("mar"),
        (F.floor(F.col("value") * 10) + 1).cast("double").alias("len"),
    )


TRAJ = """traj AS (
  SELECT event_id AS row_id, event_id // 8 AS uid, user_id AS "user", CAST(event_type = 'purchase' AS DOUBLE) AS acc,
         CAST(user_id % 2 = 0 AS DOUBLE) AS fmt, CAST(props->>'$.k' AS DOUBLE) / 100 AS mar,
         CAST(floor(value * 10) + 1 AS DOUBLE) AS len
  FROM events)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: row_id (a user), pos, r, v, lp, ref, mask. Positions by event_id."""
    e = events(spark, sf_dir)
    pos = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("pos")
    return e.select(F.col("user_id").alias("row_id"), pos, (F.col("value") / 97).alias("r"), (F.col("k") / 103).alias("v"), (-F.col("value") / 97).alias("lp"), (-F.col("k") / 103).alias("ref"), (F.col("event_type") != "error").cast("double").alias("mask"))


TOKENS = """tokens AS (
  SELECT user_id AS row_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, value / 97 AS r,
         CAST(props->>'$.k' AS DOUBLE) / 103 AS v, -value / 97 AS lp, -CAST(props->>'$.k' AS DOUBLE) / 103 AS ref,
         CAST(event_type <> 'error' AS DOUBLE) AS mask
  FROM events)"""


def _field(name: str):
    return lambda x: x[name]


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a user, with arrays in order of pos."""
    items = F.sort_array(F.collect_list(F.struct("pos", "r", "v", "lp", "ref", "mask")))
    rows = tokens(spark, sf_dir).groupBy("row_id").agg(items.alias("x"))
    names = {"rewards": "r", "values": "v", "log_probs": "lp", "refs": "ref", "mask": "mask"}
    return rows.select("row_id", *[F.transform("x", _field(c)).alias(n) for n, c in names.items()])


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as attention mass: 4 layers, 4 heads, 4 tokens."""
    flat = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample"), F.posexplode("embedding").alias("i", "x"))
    return flat.select("sample", F.floor(F.col("i") / 16).cast("int").alias("layer"), (F.floor(F.col("i") / 4) % 4).cast("int").alias("head"), (F.col("i") % 4).cast("int").alias("resp_pos"), F.abs(F.col("x").cast("double")).alias("vis_mass"))


ATTN = """attn AS (
  SELECT vec_id AS sample, i // 16 AS layer, (i // 4) % 4 AS head, i % 4 AS resp_pos, abs(CAST(x AS DOUBLE)) AS vis_mass
  FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings))"""


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """The columns of keep, doubles rounded, and never a negative zero."""
    kinds = dict(df.dtypes)
    return df.select(*[(F.round(F.col(c), digits) + 0.0).alias(c) if kinds[c] == "double" else F.col(c) for c in keep])
