"""Rewards of responses. Rows have acc, fmt, mar (nullable), len, row_id and a group; each rule adds its columns.

Group statistics share one window. Statistics of the whole batch are scalar subqueries, so nothing is gathered in
one partition. Missing mar (null) is not mar = 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clip
from ..runtime import written
from .batch import cumulative

GROUP = 8
#: Fixed value: response lengths are set against this many characters in the baseline and single-rollout rules.
LENGTH_SCALE = 4096.0


def position_group(size: int = GROUP) -> Column:
    return F.floor(F.col("row_id") / size)


def _batch(df: DataFrame, **aggregates: Column) -> dict[str, Column]:
    row = df.agg(F.struct(*[x.alias(k) for k, x in aggregates.items()]).alias("s")).scalar()
    return {k: row[k] for k in aggregates}


def _states(df: DataFrame, tau: Column, low: Column, width: Column, difficulty: Column, rho: Column, most: float, use_len: bool, use_perc: bool, zero: float = 0.0) -> DataFrame:
    acc, mar = F.col("acc"), F.col("mar")
    over = clip(rho - 1.0, 0.0, most)
    right, wrong, unsure = (mar > tau) & (acc == 1), (mar > tau) & (acc == 0), (mar <= tau) & (acc == 1)
    length = F.when(right, clip(1.0 - rho, -1.0, 1.0)).when(wrong, difficulty * over).when(unsure, -((1.0 + difficulty) / 2.0) * clip(rho - 1.0, 0.0, 1.0)).otherwise(F.lit(zero))
    sight = F.when(right, (mar - low) / width).when(unsure, -((tau - low) / width)).otherwise(F.lit(zero))
    state = F.when(right, "A").when(wrong, "B").when(unsure, "C").otherwise("D")
    return df.withColumns({"state": state, "r_len": length if use_len else F.lit(0.0), "r_perc": sight if use_perc else F.lit(0.0), "difficulty": difficulty})


def grouped_reward(df: DataFrame, group: str = "uid", format_weight: float = 0.1, len_weight: float = 0.1, perc_weight: float = 0.1) -> DataFrame:
    """Accuracy, format, and length and perception terms by what a group does: a response counts as well grounded
    if its mar is above the group's mean less one population deviation. A weight of 0 leaves a term out. Sums run in order of
    row_id: where mar equals that bound but for rounding, the state doesn't depend on the order in which rows arrive."""
    w = Window.partitionBy(group).orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_ = _batch(df, lo=F.min("mar"), hi=F.max("mar"), any=F.max(F.col("mar").isNotNull()))
    df = df.withColumns({"__pass": F.avg("acc").over(w), "__tau": F.avg("mar").over(w) - F.stddev_pop("mar").over(w), "__avg": F.avg("len").over(w)})
    width = F.when(all_["hi"] > all_["lo"], all_["hi"] - all_["lo"]).otherwise(F.lit(1.0))
    rho = F.when(F.col("__avg") > 0, F.col("len") / F.col("__avg")).otherwise(F.lit(1.0))
    df = _states(df, F.col("__tau"), all_["lo"], width, 1.0 - F.col("__pass"), rho, 1.0, len_weight != 0, perc_weight != 0)
    overall = F.col("acc") + format_weight * F.col("fmt") + len_weight * F.col("r_len") + perc_weight * F.col("r_perc")
    return df.withColumns({"overall": overall, "mar_available": F.coalesce(all_["any"].cast("double"), F.lit(0.0))}).drop("__pass", "__tau", "__avg")


def perception_reward(df: DataFrame, group: str = "uid") -> DataFrame:
    return grouped_reward(df, group, perc_weight=0.2)


def answer_length_reward(df: DataFrame, group: str = "uid") -> DataFrame:
    return grouped_reward(df, group, perc_weight=0.0)


def answer_perception_reward(df: DataFrame, group: str = "uid") -> DataFrame:
    return grouped_reward(df, group, len_weight=0.0)


def answer_reward(df: DataFrame, format_weight: float = 0.1) -> DataFrame:
    return df.withColumns({"overall": F.col("acc") + format_weight * F.col("fmt"), "r_len": F.lit(0.0), "r_perc": F.lit(0.0), "difficulty": F.lit(0.0), "mar_available": F.col("mar").isNotNull().cast("double")})


def baseline_reward(df: DataFrame, format_weight: float = 0.1) -> DataFrame:
    overall = F.col("acc") + format_weight * F.col("fmt") - 0.01 * F.col("len") / LENGTH_SCALE
    return df.withColumns({"overall": overall, "r_len": F.lit(0.0), "r_perc": F.lit(0.0), "difficulty": F.lit(0.0), "mar": F.lit(0.0), "mar_available": F.lit(0.0)})


def batch_reward(df: DataFrame, format_weight: float = 0.1, len_weight: float = 0.1, perc_weight: float = 0.1, expected: float = 1024.0) -> DataFrame:
    """The grouped rule for single rollouts: statistics of the batch, lengths against an expected one, less a length charge."""
    all_ = _batch(df, lo=F.min("mar"), hi=F.max("mar"), mean=F.avg("mar"), dev=F.stddev_pop("mar"), acc=F.avg("acc"), any=F.max(F.col("mar").isNotNull()))
    width = F.greatest(all_["hi"] - all_["lo"], F.lit(1e-8))
    df = _states(df, all_["mean"] - all_["dev"], all_["lo"], width, 1.0 - all_["acc"], F.col("len") / expected, 0.5, True, True)
    overall = F.col("acc") + format_weight * F.col("fmt") + len_weight * F.col("r_len") + perc_weight * F.col("r_perc") - 0.01 * F.col("len") / LENGTH_SCALE
    return df.withColumns({"overall": overall, "mar_available": F.coalesce(all_["any"].cast("double"), F.lit(0.0))})


def rank_normalised(values: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Average ranks scaled to 0..1, all 0.5 if the values are all equal. Counts of the different values are added up
    by ranges, so no task sees all of them."""
    counts = values.groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    all_ = counts.agg(F.struct(F.sum("__c").alias("n"), F.count(F.lit(1)).alias("different")).alias("s")).scalar()
    ranked = cumulative(counts, value, value=F.col("__c"), name="__upto")
    below = F.col("__upto") - F.col("__c")
    ranked = ranked.withColumn(out, F.when(all_["different"] == 1, 0.5).otherwise((below + (F.col("__c") - 1) / 2.0) / (all_["n"] - 1)))
    return values.join(ranked.select(value, out), value)


def percentile(df: DataFrame, column: str, share: float) -> Column:
    """The share's percentile of a column, between its neighbours in proportion, as a scalar subquery: the neighbours
    are found by running counts of the different values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("__c"))
    n = counts.agg(F.sum("__c")).scalar()
    at = F.lit(share) * (n - 1)
    upto = cumulative(counts, column, value=F.col("__c"), name="__upto")
    ends = upto.agg(F.struct(*[F.min(F.when(F.col("__upto") > f(at), F.col(column))).alias(k) for k, f in (("low", F.floor), ("high", F.ceil))]).alias("s")).scalar()
    return ends["low"] + (ends["high"] - ends["low"]) * (at - F.floor(at))


def thinking_reward(df: DataFrame, size: int = GROUP) -> DataFrame:
    """Format and length at half weight; difficulty is (1 - pass rate) times normalised complexity, and groups above its 80th
    percentile are hard. Easy right answers earn for brevity while a budget of four fifths of the rows lasts, in
    row order; hard wrong ones for length. A last group that isn't full counts as full in its pass rate."""
    df = df.withColumn("g", position_group(size))
    groups = df.groupBy("g").agg((F.sum("acc") / size).alias("pass"), F.coalesce(F.min_by("complexity", "row_id"), F.lit(0.5)).alias("first"))
    # A row a group, read several times: for the ranks, for the percentile's bounds and for the rows.
    groups = rank_normalised(written(groups), "g", "first", "norm").withColumn("difficulty", (1.0 - F.col("pass")) * F.col("norm"))
    groups = written(groups.select("g", "difficulty"))
    hard = percentile(groups, "difficulty", 0.8)
    all_ = _batch(df, avg=F.avg("len"), n=F.count(F.lit(1)))
    df = df.join(groups.select("g", "difficulty"), "g").withColumn("hard", F.col("difficulty") > hard)
    relative = F.coalesce(F.try_divide(F.col("len").cast("double"), all_["avg"]), F.lit(0.0))
    short, long_ = ~F.col("hard") & (F.col("acc") == 1), F.col("hard") & (F.col("acc") == 0)
    df = cumulative(df.withColumn("__short", short), "row_id", value=F.col("__short").cast("long"), name="__turn", dense=True)
    gain = F.when(short & (F.col("__turn") <= F.ceil(0.8 * all_["n"])), 1.0 - relative).when(long_, F.least(relative - 1.0, F.lit(1.0))).otherwise(F.lit(0.0))
    return df.withColumns({"len_score": gain, "overall": F.col("acc") + 0.5 * F.col("fmt") + 0.5 * gain}).drop("__short", "__turn")


def token_rewards(df: DataFrame, score: str, length: str, out: str = "token_level_scores") -> DataFrame:
    """The score at a response's last token, 0 at the others; no tokens, no values."""
    n = F.col(length)
    spread = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when(i == n, F.col(score)).otherwise(F.lit(0.0)))
    return df.withColumn(out, F.when(n > 0, spread).otherwise(F.array().cast("array<double>")))
