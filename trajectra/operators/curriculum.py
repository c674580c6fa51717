"""Filtering of groups by mean accuracy, with a band that follows the progress of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW, HIGH = 0.01, 0.99

def scheduled(points: list[dict], progress: float, defaults: dict[str, float]) -> dict[str, float]:
    """The first point, by epoch_ratio, that progress hasn't passed, else the last; keys it lacks come from defaults."""
    if not points:
        return dict(defaults)
    turn = sorted(points, key=lambda p: p["epoch_ratio"])
    point = next((p for p in turn if progress <= p["epoch_ratio"]), turn[-1])
    return {k: point.get(k, v) for k, v in defaults.items()}

def schedule_lookup(rows: DataFrame, progress: str, points: DataFrame) -> DataFrame:
    """rows with the point of the schedule that is in force. points (epoch_ratio and values) is a short list that is
    broadcast as one array."""
    wide = [c for c in points.columns]
    turn = F.array_sort(F.collect_list(F.struct("epoch_ratio", *[c for c in wide if c != "epoch_ratio"])))
    all_ = points.agg(turn.alias("p")).scalar()
    rows = rows.withColumn("__p", all_)
    ahead = F.filter("__p", lambda p: F.col(progress) <= p["epoch_ratio"])
    rows = rows.withColumn("__at", F.coalesce(F.get(ahead, F.lit(0)), F.element_at("__p", -1)))
    return rows.select("*", *[F.col(f"__at.{c}").alias(c) for c in wide if c != "epoch_ratio"]).drop("__p", "__at")

def group_band(df: DataFrame, low: float = LOW, high: float = HIGH, group: str = "uid", acc: str = "acc") -> DataFrame:
    """The rows of groups whose mean accuracy lies strictly between low and high."""
    kept = df.groupBy(group).agg(F.avg(acc).alias("__mean")).where((F.col("__mean") > low) & (F.col("__mean") < high))
    return df.join(kept.select(group), group, "left_semi")

def perception_ceiling(df: DataFrame, high: float = 1.0, column: str = "h_perc") -> DataFrame:
    """Rows at or below the ceiling; 1.0 keeps all that aren't null."""
    return df.where(F.col(column) <= high)

def first_groups(df: DataFrame, n: int, order: str = "row_id", group: str = "uid") -> DataFrame:
    """The first n groups by their first row; the rest is dropped. Groups, not rows, are ranked, by a top-n."""
    turn = df.groupBy(group).agg(F.min(order).alias("__first")).orderBy("__first", group).limit(n)
    return df.join(turn.select(group), group, "left_semi")

def make_batch(df: DataFrame, target: int, low: float, high: float, group: str = "uid", acc: str = "acc", order: str = "row_id") -> DataFrame:
    """What accumulation of mini-batches ends with: the first target groups of those in the band; fewer raise."""
    kept = first_groups(group_band(df, low, high, group, acc), target, order, group)
    n = kept.agg(F.count_distinct(group)).scalar()
    return kept.where(F.when(n == target, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{target} groups wanted, in the band: "), n.cast("string")))))

def progress_of(step: Column, steps: int) -> Column:
    return step.cast("double") / F.lit(float(steps))
