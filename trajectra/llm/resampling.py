"""Importance resampling towards a target text: hashed word features by a vectorised automaton, additive gains, a draw without replacement.

The automaton runs over the UTF-8 buffer of an Arrow column as it is: a table says which bytes are of words, differences
of that where words begin and end, and a table-driven CRC advances from all beginnings at once, byte after byte.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .items import map_arrow
from .merge_rounds import ranges
from .ordering import numbered

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS, PERCENT = 20, 10
#: Longer words advance in pieces of so many bytes, all at once.
STRIDE = 64
_POLYNOMIAL = 0xEDB88320


@functools.lru_cache(maxsize=1)
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Bytes with A-Z as a-z, and which bytes are of words: digits, letters and all beyond ASCII."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return lower, word


@functools.lru_cache(maxsize=1)
def _step() -> np.ndarray:
    """What the low byte of a register becomes."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(_POLYNOMIAL), out >> 1)
    return out


def _apply(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    return table[0][register & 255] ^ table[1][register >> 8 & 255] ^ table[2][register >> 16 & 255] ^ table[3][register >> 24]


@functools.lru_cache(maxsize=40)
def _skip(power: int) -> np.ndarray:
    """How a register changes with 2**power zero bytes, by its four bytes."""
    each = np.arange(256, dtype=np.uint32)
    of = [each << np.uint32(8 * k) for k in range(4)]
    if power == 0:
        return np.stack([x >> np.uint32(8) ^ _step()[x & 255] for x in of])
    half = _skip(power - 1)
    return np.stack([_apply(half, _apply(half, x)) for x in of])


def advance(data: np.ndarray, register: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The registers after the bytes data[starts[i] : starts[i] + sizes[i]]; sizes are at least 1.

    A register is linear in its beginning and its bytes: the pieces of a long word advance side by side, all but the first
    from zero, and each is carried over the bytes behind it before they are added up.
    """
    if not len(starts):
        return register
    pieces = -(-sizes // STRIDE)
    number = ranges(np.zeros(len(pieces), np.int64), pieces)
    head = np.repeat(sizes - (pieces - 1) * STRIDE, pieces)
    begin = np.repeat(starts, pieces) + np.where(number > 0, head + (number - 1) * STRIDE, 0)
    length = np.where(number > 0, STRIDE, head)
    state = np.where(number > 0, np.uint32(0), np.repeat(register, pieces))
    order = np.argsort(-length, kind="stable")
    state, begin, table = state[order], begin[order], _step()
    # How many pieces have more than j bytes.
    active = len(length) - np.cumsum(np.bincount(length, minlength=STRIDE + 1))
    for j in range(int(length.max())):
        k = active[j]
        now = state[:k]
        state[:k] = now >> np.uint32(8) ^ table[(now ^ data[begin[:k] + j]) & 255]
    out = np.empty_like(state)
    out[order] = state
    behind = np.repeat(pieces, pieces) - 1 - number
    stride = STRIDE.bit_length() - 1
    for power in range(int(behind.max()).bit_length()):
        hit = np.flatnonzero(behind >> power & 1)
        out[hit] = _apply(_skip(power + stride), out[hit])
    return np.bitwise_xor.reduceat(out, np.cumsum(pieces) - pieces)


def word_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a string column with A-Z as a-z, starts and sizes of the words, and how many words each row has. Null is no text."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    lower, word = _bytes()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, content = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = lower[np.frombuffer(content or b"", np.uint8)[bounds[0] : bounds[-1]]]
    bounds -= bounds[0]
    # No word goes over the bounds of rows.
    inside = word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    step = np.diff(np.concatenate([[False], inside, [False]]).view(np.int8))
    starts = np.flatnonzero((step[:-1] == 1) | inside & edge[:-1])
    ends = np.flatnonzero((step[1:] == -1) | inside & edge[1:]) + 1
    return data, starts, ends - starts, np.diff(np.searchsorted(starts, bounds))


def features(column: pa.Array, longest: int = 1, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the features of all rows, which row each is of, and how many words each row has. A feature is a run of 1 to longest
    words, joined by one space; its bucket is the CRC-32 of its bytes modulo buckets."""
    data, starts, sizes, words = word_places(column)
    row = np.repeat(np.arange(len(words)), words)
    found, of = [], []
    state, first = np.full(len(starts), 0xFFFFFFFF, np.uint32), np.arange(len(starts))
    for n in range(longest):
        if n:
            stay = np.flatnonzero(first + n < len(starts))
            stay = stay[row[first[stay] + n] == row[first[stay]]]
            state, first = state[stay], first[stay]
            state = state >> np.uint32(8) ^ _step()[(state ^ np.uint32(32)) & 255]
        state = advance(data, state, starts[first + n], sizes[first + n])
        found.append((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        of.append(row[first])
    return np.concatenate(found).astype(np.int64), np.concatenate(of), words


def bucket_counts(df: DataFrame, text_col: str = "text", longest: int = 1, buckets: int = BUCKETS) -> dict[int, int]:
    """How many features of all texts fall into each bucket. A task sends a row a bucket at most, and so many come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(features(batch.column(0), longest, buckets)[0], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    rows = map_arrow(df.select(F.col(text_col).cast("string").alias("text")), count, "bucket long, n long")
    return {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(own: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln of the ratio of a bucket's smoothed share in the target to that in the own texts), by bucket."""
    own_all, target_all = float(sum(own.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * own_all / ((own.get(b, 0) + 1.0) * target_all))) for b in range(buckets)], np.int64)


def weigh(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = 1) -> DataFrame:
    """id, n_words, n_features and weight, the sum of the gains of its features, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, row, words = features(batch.column(1), longest, len(gain))
            weight = np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, row, gain[bucket])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(np.bincount(row, minlength=batch.num_rows)), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return map_arrow(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, n_words long, n_features long, weight long")


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """id_col, n_words, n_features, weight, score and rank for every row of df; rank is 1, 2, ... for those drawn, null for others.

    score is weight plus Gumbel noise of a hash of seed and id, so the highest scores are a draw without replacement by weight. Of
    the rows with least_words words, percent in a hundred are drawn; ties go to the smaller id, null ids last, and between rows equal in score and id to
    either. A null text has no words; a null id's hash is that of an empty one. Rows that repeat an id are rows of their own. Without
    features in df or in target the shares are those of the smoothing alone; an empty table gives none.
    """
    gain = gains(bucket_counts(df, text_col, longest, buckets), bucket_counts(target, target_col, longest, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = weigh(df, gain, id_col, text_col, longest).withColumn("score", F.col("weight") + noise)
    rows = materialise(rows.withColumn("mark", F.monotonically_increasing_id()), "weighed")
    able = F.col("n_words") >= least_words
    # Ascending: the highest score first, then the smallest id.
    order = rows.where(able).withColumns({"key": F.lit(0), "down": -F.col("score"), "no_id": F.col("id").isNull()})
    ranked = numbered(order, ["down", "no_id", "id", "mark"])
    ranked = ranked.withColumn("rank", F.when(F.col("idx") < F.floor(F.col("n") * percent / 100), F.col("idx") + 1))
    out = ranked.select("id", "n_words", "n_features", "weight", "score", "rank").unionByName(rows.where(~able).drop("mark").withColumn("rank", F.lit(None).cast("long")))
    return out.withColumnRenamed("id", id_col)
