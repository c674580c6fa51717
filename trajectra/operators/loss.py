"""Objectives in long form: one row a valid token, with row_id; arrays of a batch go through explode_tokens first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clip

EPS = 1e-8


def policy_terms(df: DataFrame, low: float = 0.2, high: float = 0.3, dual: float = 3.0, old: str = "old", new: str = "new", adv: str = "adv") -> DataFrame:
    """token_loss with clipped ratio, bounded by dual for negative advantages; whether it was clipped high or low; neg_kl."""
    x = clip(F.col(new) - F.col(old), -20.0, 20.0)
    a = F.col(adv)
    free = -a * F.exp(x)
    clipped = -a * F.exp(clip(x, math.log(1.0 - low), math.log(1.0 + high)))
    worse = F.greatest(free, clipped)
    bounded = F.least(worse, -a * dual)
    return df.withColumns({
        "token_loss": F.when(a < 0, bounded).otherwise(worse),
        "clipped_high": (free < clipped).cast("double"),
        "clipped_low": F.when(a < 0, (worse > -a * dual).cast("double")).otherwise(F.lit(0.0)),
        "neg_kl": -x,
    })


def average(value: str | Column, mode: str, df: DataFrame) -> DataFrame:
    """One row, column loss: over all tokens (token) or the mean of each row's mean (seq)."""
    x = F.col(value) if isinstance(value, str) else value
    if mode == "token":
        return df.agg((F.sum(x) / (F.count(x) + F.lit(EPS))).alias("loss"))
    if mode == "seq":
        return df.groupBy("row_id").agg((F.sum(x) / (F.count(x) + F.lit(EPS))).alias("m")).agg(F.avg("m").alias("loss"))
    raise ValueError(f"mode is token or seq, not {mode}")


def policy_loss(df: DataFrame, mode: str = "token", **options) -> DataFrame:
    """One row: pg_loss, pg_clipfrac_higher, pg_clipfrac_lower, ppo_kl, entropy_loss."""
    terms = policy_terms(df, **options)
    new = options.get("new", "new")
    means = {"pg_clipfrac_higher": "clipped_high", "pg_clipfrac_lower": "clipped_low", "ppo_kl": "neg_kl"}
    share = lambda c: F.sum(c) / (F.count(F.lit(1)) + F.lit(EPS))
    if mode == "token":
        loss = [share("token_loss").alias("pg_loss"), share(-F.col(new)).alias("entropy_loss")]
        return terms.agg(*loss, *[share(c).alias(k) for k, c in means.items()])
    rows = terms.groupBy("row_id").agg(share("token_loss").alias("l"), share(-F.col(new)).alias("e"), F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in means.items()])
    return rows.agg(F.avg("l").alias("pg_loss"), F.avg("e").alias("entropy_loss"), *[(F.sum(k) / (F.sum("n") + F.lit(EPS))).alias(k) for k in means])


def value_loss(df: DataFrame, clip_range: float = 0.5, mode: str = "token", pred: str = "pred", returns: str = "returns", values: str = "values") -> DataFrame:
    """One row: vf_loss, vf_clipfrac, vpred_mean."""
    near = clip(F.col(pred), F.col(values) - clip_range, F.col(values) + clip_range)
    free, held = F.pow(F.col(pred) - F.col(returns), 2.0), F.pow(near - F.col(returns), 2.0)
    terms = df.select("row_id", F.greatest(free, held).alias("x"), (free < held).cast("double").alias("c"), F.col(pred).alias("p"))
    share = lambda c: F.sum(c) / (F.count(F.lit(1)) + F.lit(EPS))
    if mode == "token":
        return terms.agg((0.5 * share("x")).alias("vf_loss"), share("c").alias("vf_clipfrac"), share("p").alias("vpred_mean"))
    rows = terms.groupBy("row_id").agg(share("x").alias("x"), F.sum("c").alias("c"), F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"))
    return rows.agg((0.5 * F.avg("x")).alias("vf_loss"), (F.sum("c") / (F.sum("n") + F.lit(EPS))).alias("vf_clipfrac"), (F.sum("p") / (F.sum("n") + F.lit(EPS))).alias("vpred_mean"))


def scaled_loss(pg: Column, kl: Column, beta: float, tokens: Column, world: int, all_tokens: Column) -> Column:
    return (pg + beta * kl) * tokens * world / all_tokens


def finite(x: Column) -> Column:
    """False for null, NaN and infinities: a step with such a norm is passed over."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))
