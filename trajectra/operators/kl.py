"""Divergence estimators of token log probabilities and the controllers of their coefficient."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import masked_row_mean
from ..functions.scalar import clip


def kl_term(log_prob: Column, ref: Column, kind: str) -> Column:
    """Of one token. kind: kl, abs, mse, low_var_kl; full takes arrays over the vocabulary."""
    if kind == "full":
        return F.aggregate(F.zip_with(ref, log_prob, lambda r, p: F.exp(r) * (r - p)), F.lit(0.0), lambda a, x: a + x)
    d = log_prob - ref
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        back = clip(-d, -20.0, 20.0)
        return clip(F.exp(back) - back - 1.0, -10.0, 10.0)
    raise ValueError(f"unknown estimator {kind}")


def kl_tokens(log_probs: str | Column, refs: str | Column, kind: str) -> Column:
    return F.zip_with(log_probs, refs, lambda p, r: kl_term(p, r, kind))


def rewards_less_kl(scores: str | Column, kl: str | Column, beta) -> Column:
    return F.zip_with(scores, kl, lambda s, k: s - k * beta)


@dataclass
class FixedKL:
    beta: float

    def update(self, kl: float, steps: int, accuracy: float | None = None) -> None:
        pass


@dataclass
class AdaptiveKL:
    beta: float
    target: float
    horizon: float

    def update(self, kl: float, steps: int, accuracy: float | None = None) -> None:
        error = min(max(kl / self.target - 1.0, -0.2), 0.2)
        self.beta *= 1.0 + error * steps / self.horizon


@dataclass
class AccuracyKL:
    """The coefficient falls from high to low as accuracy rises; none, no change."""

    low: float
    high: float
    beta: float

    def update(self, kl: float, steps: int, accuracy: float | None = None) -> None:
        if accuracy is not None:
            self.beta = self.low + (self.high - self.low) * (1.0 - accuracy)


def controller(kind: str, beta: float, target: float = 0.1, horizon: float = 10_000.0, low: float = 0.0, high: float = 0.1):
    """fixed, adaptive, accuracy_based; the two group kinds start like accuracy_based and use the functions below."""
    if kind == "fixed":
        return FixedKL(beta)
    if kind == "adaptive":
        if horizon <= 0:
            raise ValueError("horizon must be positive")
        return AdaptiveKL(beta, target, horizon)
    if kind in ("accuracy_based", "group_accuracy_based", "perception_aware"):
        return AccuracyKL(low, high, beta)
    raise ValueError(f"unknown controller {kind}")


def group_accuracy_coefficients(df: DataFrame, low: float, high: float, n: int, acc: str = "acc", out: str = "kl_coef") -> DataFrame:
    """Of each n rows in order; a rest is a group of its own."""
    w = Window.partitionBy(F.floor(F.col("row_id") / n))
    return df.withColumn(out, F.lit(low) + (high - low) * (1.0 - F.avg(acc).over(w)))


def perception_coefficients(df: DataFrame, low: float, high: float, threshold: float, n: int, h_perc: str = "h_perc", h_ans: str = "h_ans", scale: float = 0.25, out: str = "kl_coef") -> DataFrame:
    """By the first row of each n: unsure perception gives the high coefficient, else the surer the answer the higher."""
    w = Window.partitionBy(F.floor(F.col("row_id") / n))
    first = F.min(F.struct("row_id", h_perc, h_ans)).over(w)
    sure = F.lit(low) + (high - low) * (1.0 - F.least(first[h_ans] / scale, F.lit(1.0)))
    return df.withColumn(out, F.when(first[h_perc] >= threshold, F.lit(high)).otherwise(sure))


def apply_kl_penalty(df: DataFrame, ctl, kind: str, scores: str = "scores", log_probs: str = "log_probs", refs: str = "refs", mask: str = "mask") -> tuple[DataFrame, DataFrame]:
    """(df with rewards, one row of metrics with the coefficient that was used). Update ctl with the metrics' kl."""
    df = df.withColumn("kl", F.zip_with(kl_tokens(log_probs, refs, kind), mask, lambda k, m: k * m))
    df = df.withColumn("rewards", rewards_less_kl(scores, "kl", F.lit(ctl.beta)))
    metrics = df.agg(F.avg(masked_row_mean(F.col("kl"), F.col(mask))).alias("kl"), F.lit(ctl.beta).alias("kl_coef"), F.count(F.lit(1)).alias("rows"))
    return df, metrics
