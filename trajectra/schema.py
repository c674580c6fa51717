"""Explicit schemas. Optional columns are always there and nullable; nothing is told by a column's absence."""

from __future__ import annotations

from pyspark.sql import types as T

PROMPTS = T.StructType(
    [T.StructField("question", T.StringType(), False), T.StructField("answer", T.StringType(), False)]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("image", "videos")]
    + [T.StructField(c, T.StringType()) for c in ("category", "source", "qid", "split")]
    + [T.StructField("image_complexity", T.DoubleType())]
)
REWARD_INPUT = T.StructType(
    [T.StructField("response", T.StringType()), T.StructField("response_length", T.IntegerType()), T.StructField("ground_truth", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("image_complexity", "mar")]
)
REWARD_SCORE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("overall", "accuracy", "format", "r_len", "r_perc", "mar", "mar_available", "difficulty")])
ATTENTION = T.StructType([T.StructField("sample", T.LongType())] + [T.StructField(c, T.IntegerType()) for c in ("layer", "head", "resp_pos")] + [T.StructField("vis_mass", T.DoubleType())])
#: Every row's place in its batch, dense from 0. Rows of a prompt share uid and differ in rollout_idx.
ORDER = T.StructType([T.StructField("row_id", T.LongType(), False), T.StructField("uid", T.StringType()), T.StructField("rollout_idx", T.IntegerType())])
