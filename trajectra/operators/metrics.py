"""One-row records about batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduce_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c in columns])


def masked_mean(df: DataFrame, value: str, mask: str, eps: float = 1e-8) -> Column:
    return F.sum(F.col(value) * F.col(mask)) / (F.sum(mask) + F.lit(eps))


def masked_variance(df: DataFrame, value: str, mask: str, unbiased: bool = True, eps: float = 1e-8) -> DataFrame:
    """One row, var: about the masked mean, times n / (n - 1) if there is more than one value."""
    mean = df.agg(masked_mean(df, value, mask, eps)).scalar()
    square = (F.col(value) - mean) * (F.col(value) - mean) * F.col(mask)
    n = F.sum(mask).cast("double")
    var = F.sum(square) / (n + F.lit(eps))
    return df.agg(F.when(F.lit(unbiased) & (n > 1), var * n / F.when(n > 1, n - 1)).otherwise(var).alias("var"))


def spread_of(prefix: str, x: str | Column) -> list[Column]:
    c = F.col(x) if isinstance(x, str) else x
    return [F.avg(c).alias(f"{prefix}_mean"), F.max(c).alias(f"{prefix}_max"), F.min(c).alias(f"{prefix}_min")]


def length_metrics(df: DataFrame, prompt: str, response: str, prompt_cap: int, response_cap: int) -> DataFrame:
    """Mean, largest, least length and share at the cap, of prompts and responses."""
    out = []
    for name, cap in ((prompt, prompt_cap), (response, response_cap)):
        out += spread_of(name, name) + [F.avg((F.col(name) == cap).cast("double")).alias(f"{name}_clip_ratio")]
    return df.agg(*out)


def data_metrics(rows: DataFrame, tokens: DataFrame, critic: bool) -> DataFrame:
    """One row: score and reward by row; advantages, returns and values by token; with critic the explained variance."""
    top = rows.agg(*spread_of("score", "score"), *spread_of("reward", "reward"))
    columns = [*spread_of("advantages", "advantage"), *spread_of("returns", "ret")]
    if critic:
        left, all_ = F.var_samp(F.col("ret") - F.col("value")), F.var_samp("ret")
        columns += [*spread_of("values", "value"), (1.0 - left / (all_ + 1e-5)).alias("vf_explained_var")]
    below = tokens.agg(F.struct(*columns).alias("s"))
    return top.withColumn("__s", below.scalar()).select(*top.columns, "__s.*")


#: Sections that are timed by tokens of responses, and by all tokens.
BY_RESPONSE, BY_ALL = ("gen", "reward"), ("ref", "old", "values", "adv", "update_critic", "update_actor")


def timing_per_token(timings: DataFrame, response_tokens: int | Column, all_tokens: int | Column) -> DataFrame:
    """timings (section, seconds) with milliseconds a token for the sections that have a token count: a number or a scalar subquery."""
    counts = [x if isinstance(x, Column) else F.lit(x) for x in (response_tokens, all_tokens)]
    tokens = F.when(F.col("section").isin(*BY_RESPONSE), counts[0]).otherwise(counts[1])
    known = timings.where(F.col("section").isin(*BY_RESPONSE, *BY_ALL))
    return known.select("section", "seconds", (F.col("seconds") * 1000 / tokens).alias("ms_per_token"))


def throughput(tokens: Column, seconds: Column, devices: int) -> Column:
    return tokens / (seconds * devices)


def validation_scores(df: DataFrame, names: str = "val_name", score: str = "score") -> DataFrame:
    """Mean score of each set and the mean of these means."""
    each = df.groupBy(names).agg(F.avg(score).alias("score"))
    return each.withColumn("all_sets", each.agg(F.avg("score")).scalar())


def best_so_far(history: DataFrame, names: str = "val_name", step: str = "step", score: str = "score") -> DataFrame:
    """Of each set the best score and the first step that reached it."""
    best = F.max(F.struct(F.col(score), (-F.col(step)).alias("s")))
    return history.groupBy(names).agg(best.alias("b")).select(names, F.col(f"b.{score}").alias("best_score"), (-F.col("b.s")).alias("best_step"))


def batch_means(df: DataFrame, batch: str, columns: list[str]) -> DataFrame:
    """Means over batches of each batch's mean, unweighted."""
    return df.groupBy(batch).agg(*[F.avg(c).alias(c) for c in columns]).agg(*[F.avg(c).alias(c) for c in columns])


def append_values(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    items = F.sort_array(F.collect_list(F.struct(order, value)))
    return df.groupBy(key).agg(F.transform(items, lambda x: x[value]).alias(value))
