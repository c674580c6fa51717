"""Dealing rows of different lengths to parts of about equal weight: largest differencing, lightest bin, micro-batches."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batch import pad_to_multiple, size_of


def differencing(lengths: list[int], k: int, equal_size: bool) -> list[list[int]]:
    """Largest differencing: partial solutions of k sums; the two with the widest spread are merged, heaviest part of one
    with lightest part of the other, until one is left. With equal_size k items of neighbouring lengths start each
    solution, so every part gets as many; and where a part is heavier or lighter than all contiguous parts, rows are exchanged."""
    if equal_size and len(lengths) % k:
        raise ValueError(f"{len(lengths)} rows can't be dealt to {k} equal parts")
    rising = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    seeds = [rising[i : i + k] for i in range(0, len(rising), k)] if equal_size else [[i] for i in rising]
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    for turn, seed in enumerate(seeds):
        parts = sorted([(lengths[i], [i]) for i in seed] + [(0, [])] * (k - len(seed)), reverse=True)
        heap.append((parts[-1][0] - parts[0][0], turn, parts))
    heapq.heapify(heap)
    turn = len(seeds)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))), reverse=True)
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], turn, parts))
        turn += 1
    parts = [sorted(items) for _, items in heap[0][2]] if heap else [[] for _ in range(k)]
    return _not_wider(lengths, parts) if equal_size else parts


def _not_wider(lengths: list[int], parts: list[list[int]]) -> list[list[int]]:
    """parts whose sums lie between those of the lightest and the heaviest of as many contiguous parts. Each exchange of two rows moves the
    sums of two parts towards each other, so none gets further out; if no exchange is left, the contiguous parts themselves."""
    size = len(lengths) // len(parts)
    plain = [list(range(i, i + size)) for i in range(0, size * len(parts), size)] or parts
    weigh = lambda items: sum(lengths[i] for i in items)
    low, high = min(map(weigh, plain)), max(map(weigh, plain))
    parts = [list(p) for p in parts]
    while (sums := [weigh(p) for p in parts]) and (max(sums) > high or min(sums) < low):
        rising = sorted(range(len(parts)), key=lambda p: sums[p])
        tried = [(rising[-1], p) for p in rising[:-1]] if max(sums) > high else [(p, rising[0]) for p in rising[:0:-1]]
        for a, b in tried:
            gap = sums[a] - sums[b]
            swaps = [(abs(2 * (lengths[x] - lengths[y]) - gap), x, y) for x in parts[a] for y in parts[b] if 0 < lengths[x] - lengths[y] < gap]
            if swaps:
                _, x, y = min(swaps)
                parts[a][parts[a].index(x)], parts[b][parts[b].index(y)] = y, x
                break
        else:
            return plain
    return [sorted(p) for p in parts]


def lightest_bin(lengths: list[int], k: int, equal_size: bool) -> list[list[int]]:
    """Each row in turn to the part that weighs least; with equal_size a constant larger than all lengths makes counts come first."""
    bias = sum(lengths) + 1 if equal_size else 0
    heap = [(0, i) for i in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for row, n in enumerate(lengths):
        weight, part = heapq.heappop(heap)
        parts[part].append(row)
        heapq.heappush(heap, (weight + n + bias, part))
    return parts


def balanced_parts(lengths: list[int], k: int, equal_size: bool = True, by: Callable = differencing) -> list[list[int]]:
    """k parts, none empty, that cover all rows once, each in rising order."""
    if len(lengths) < k:
        raise ValueError(f"{len(lengths)} rows for {k} parts")
    parts = [sorted(p) for p in by(lengths, k, equal_size)]
    if any(not p for p in parts) or sorted(i for p in parts for i in p) != list(range(len(lengths))):
        raise ValueError("the parts don't cover the rows")
    return parts


def deal(df: DataFrame, k: int, batch: str = "batch_id", length: str = "length", equal_size: bool = True, by: Callable = differencing) -> DataFrame:
    """batch, row_id, part: each batch is dealt by itself in one task, so batches must be of bounded size. Without
    equal_size a batch of fewer than k rows is dealt to as many parts as it has rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id").reset_index(drop=True)
        part = pd.Series(0, index=rows.index)
        parts = k if equal_size else min(k, len(rows))
        for p, items in enumerate(balanced_parts([int(x) for x in rows[length]], parts, equal_size, by)):
            part[items] = p
        return pd.DataFrame({batch: rows[batch], "row_id": rows["row_id"], "part": part})

    return df.select(batch, "row_id", length).groupBy(batch).applyInPandas(run, f"{batch} long, row_id long, part long")


def micro_batches(df: DataFrame, max_tokens: int, batch: str = "batch_id", length: str = "length", together: str | None = None) -> DataFrame:
    """batch, row_id, part, turn: ceil(tokens / max_tokens) parts a batch, in falling order of their sums of squared
    lengths, ties the later first. Balances, and doesn't promise max_tokens. Batches of the same value of together, one a rank, all
    get as many parts as the one that needs most, so that ranks take equally many steps; a batch with fewer rows than that raises."""
    own = Window.partitionBy(batch)
    need = F.least(F.count(F.lit(1)).over(own), F.greatest(F.lit(1), F.ceil(F.sum(length).over(own) / max_tokens)))
    rows = df.select(batch, "row_id", length, *([] if together is None else [together])).withColumn("__k", need.cast("long"))
    if together is not None:
        rows = rows.withColumn("__k", F.max("__k").over(Window.partitionBy(together))).drop(together)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id").reset_index(drop=True)
        lengths = [int(x) for x in rows[length]]
        k = int(rows["__k"].iloc[0])
        parts = balanced_parts(lengths, k, equal_size=False)
        turn = sorted(range(k), key=lambda p: (sum(lengths[i] ** 2 for i in parts[p]), min(parts[p])), reverse=True)
        out = pd.DataFrame({batch: rows[batch], "row_id": rows["row_id"], "part": 0, "turn": 0})
        for t, p in enumerate(turn):
            out.loc[parts[p], ["part", "turn"]] = p, t
        return out

    return rows.groupBy(batch).applyInPandas(run, f"{batch} long, row_id long, part long, turn long")


def imbalance(df: DataFrame, k: int, batch: str = "batch_id", length: str = "length", part: str = "part") -> DataFrame:
    """Of each batch: least, most and difference of the sums of k contiguous parts (a rest goes to the last), least and most
    of the dealt parts, and the mean of a part."""
    w = Window.partitionBy(batch)
    rows, turn = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy("row_id")) - 1
    before = df.withColumn("__p", F.least(F.floor(turn / F.greatest(F.floor(rows / k), F.lit(1))), F.lit(k - 1)))
    before = before.groupBy(batch, "__p").agg(F.sum(length).alias("s")).groupBy(batch).agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.sum("s") / k).alias("mean"))
    after = df.groupBy(batch, part).agg(F.sum(length).alias("s")).groupBy(batch).agg(F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max"))
    return before.join(after, batch).withColumn("minmax_diff", F.col("max") - F.col("min"))


def shard(df: DataFrame, world: int, rank: int) -> DataFrame:
    """The rows of one of world contiguous parts, after padding to a multiple of world."""
    padded = pad_to_multiple(df, world)
    size = size_of(padded) / world
    return padded.where(F.floor(F.col("row_id") / size) == rank)
