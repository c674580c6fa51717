"""Advantage estimators, by name. Token values are ragged arrays of valid tokens; group estimators need two rows a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import next_value, reverse_scan, total

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register_estimator(name: str):
    def add(f):
        if name in ESTIMATORS:
            raise ValueError(f"there is an estimator {name}")
        ESTIMATORS[name] = f
        return f

    return add


def advantage(name: str, df: DataFrame, **options) -> DataFrame:
    return ESTIMATORS[name](df, **options)


def _pairs_only(n: Column, x: Column) -> Column:
    return F.when(n > 1, x).otherwise(F.raise_error("a group has one row"))


def whiten(df: DataFrame, column: str, eps: float = 1e-8) -> DataFrame:
    """Values less their mean, over the root of their unbiased variance, of all tokens of the batch."""
    x = F.col("x")
    row = df.select(F.explode(column).alias("x")).agg(F.struct(F.sum(x).alias("s"), F.count(x).cast("double").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).alias("all")).scalar()
    n, m = row["n"], row["m"]
    mean = row["s"] / (n + F.lit(eps))
    # Squares about the mean as it is defined here, from those about the plain one.
    variance = n * (row["v"] + (m - mean) * (m - mean)) / (n + F.lit(eps))
    unbiased = F.when(n > 1, variance * n / (n - 1)).otherwise(variance)
    df = df.withColumns({"__mean": mean, "__scale": F.lit(1.0) / F.sqrt(unbiased + F.lit(eps))})
    return df.withColumn(column, F.transform(column, lambda x: (x - F.col("__mean")) * F.col("__scale"))).drop("__mean", "__scale")


@register_estimator("gae")
def gae(df: DataFrame, rewards: str = "rewards", values: str = "values", gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """advantages (whitened) and returns (before whitening) by the discounted sum of temporal differences."""
    r, v = F.col(rewards), F.col(values)
    delta = F.transform(r, lambda x, t: x + gamma * next_value(v, t) - F.get(v, t))
    df = df.withColumn("__delta", delta)
    df = df.withColumn("advantages", reverse_scan(F.col("__delta"), gamma * lam)).drop("__delta")
    df = df.withColumn("returns", F.zip_with("advantages", v, lambda a, b: a + b))
    return whiten(df, "advantages")


@register_estimator("grpo")
def grpo(df: DataFrame, score: str = "score", group: str = "uid", eps: float = 1e-6) -> DataFrame:
    w = Window.partitionBy(group)
    x = (F.col(score) - F.avg(score).over(w)) / (F.stddev_samp(score).over(w) + F.lit(eps))
    return df.withColumn("advantage", _pairs_only(F.count(score).over(w), x))


@register_estimator("rloo")
def rloo(df: DataFrame, score: str = "score", group: str = "uid") -> DataFrame:
    w = Window.partitionBy(group)
    n = F.count(score).over(w)
    x = F.col(score) - (F.sum(score).over(w) - F.col(score)) / F.when(n > 1, n - 1)
    return df.withColumn("advantage", _pairs_only(n, x))


@register_estimator("reinforce_plus_plus")
def reinforce_plus_plus(df: DataFrame, rewards: str = "rewards", gamma: float = 1.0) -> DataFrame:
    df = df.withColumn("returns", reverse_scan(F.col(rewards), gamma)).withColumn("advantages", F.col("returns"))
    return whiten(df, "advantages")


@register_estimator("remax")
def remax(df: DataFrame, rewards: str = "rewards", baseline: str = "reward_baseline") -> DataFrame:
    return df.withColumn("advantage", total(F.col(rewards)) - F.col(baseline))


def spread(df: DataFrame, value: str, tokens: str, out: str = "advantages") -> DataFrame:
    """A row's value at each of its tokens."""
    return df.withColumn(out, F.transform(tokens, lambda _: F.col(value)))
