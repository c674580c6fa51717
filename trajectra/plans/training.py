"""One training step as one plan: reward, curriculum band, limit, group-relative advantage, step metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.advantage import grpo
from ..operators.curriculum import first_groups, group_band
from ..operators.rewards import grouped_reward


def training_step(traj: DataFrame, low: float, high: float, target: int) -> DataFrame:
    """Groups in the band, the first target of them; statistics are taken of what is left. One row of metrics."""
    kept = first_groups(group_band(traj, low, high), target)
    scored = grpo(grouped_reward(kept), score="overall")
    return scored.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(f"{c}_mean") for c in ("overall", "acc", "r_len", "r_perc", "difficulty")], F.max("advantage").alias("advantage_max"), F.min("advantage").alias("advantage_min"))
