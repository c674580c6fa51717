"""Visual attention ratio of responses, from attention in long form: sample, layer, head, resp_pos, vis_mass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_TOKENS = 64


def _top_mean(per_token: DataFrame, weight: str, tokens: int, value: str = "m") -> DataFrame:
    """Mean of weight over the quarter of tokens, one at least, whose m is largest."""
    k = max(1, tokens // 4)
    w = Window.partitionBy("sample").orderBy(F.desc(value), "resp_pos")
    return per_token.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).groupBy("sample").agg(F.avg(weight).alias("mar"))


def middle_layers(attn: DataFrame, layers: int, heads: int, tokens: int) -> DataFrame:
    """All mass of the middle half of the layers over its cells; tokens counts padded places too."""
    low, high = layers // 4, 3 * layers // 4
    cells = (high - low) * heads * min(tokens, MAX_TOKENS)
    return attn.where((F.col("layer") >= low) & (F.col("layer") < high)).groupBy("sample").agg((F.sum("vis_mass") / F.lit(float(cells))).alias("mar"))


def top_tokens(attn: DataFrame, tokens: int) -> DataFrame:
    """Mean over heads and layers of each token, then of the top quarter of tokens."""
    per_token = attn.groupBy("sample", "resp_pos").agg(F.avg("vis_mass").alias("m"))
    return _top_mean(per_token, "m", min(tokens, MAX_TOKENS))


def selected_heads(attn: DataFrame, pairs: list[tuple[int, int]], tokens: int) -> DataFrame:
    """As top_tokens, over the listed (layer, head) pairs only."""
    wanted = attn.sparkSession.createDataFrame(sorted(set(pairs)), "layer int, head int")
    return top_tokens(attn.join(F.broadcast(wanted), ["layer", "head"], "left_semi"), tokens)


def ratios(samples: DataFrame, attn: DataFrame, mode: str, layers: int, heads: int, tokens: int, pairs: list[tuple[int, int]] = ()) -> DataFrame:
    """sample, mar for every sample; 0.0 where there is no vision token, and everywhere in mode disabled."""
    if mode == "disabled":
        return samples.select("sample", F.lit(0.0).alias("mar"))
    found = {"mid": lambda: middle_layers(attn, layers, heads, tokens), "full_topk": lambda: top_tokens(attn, tokens), "vsh": lambda: selected_heads(attn, list(pairs), tokens)}[mode]()
    return samples.select("sample").join(found, "sample", "left").select("sample", F.coalesce("mar", F.lit(0.0)).alias("mar"))


def summary(ratios_: DataFrame) -> DataFrame:
    """One row: how many ratios there are, how many are above 0, their mean and the largest."""
    m = F.col("mar")
    return ratios_.agg(F.count(F.lit(1)).alias("total"), F.count_if(m > 0).alias("nonzero"), F.avg(m).alias("mean"), F.max(m).alias("max"))
