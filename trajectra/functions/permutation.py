"""A shuffled order of 0..n-1 of which any place can be computed by itself, without sorting or storing it.

A Feistel network over pairs (left, right) with left < a, right < b and a b just above n permutes all pairs; what falls outside
0..n-1 is sent through it again until it falls inside, so the numbers below n are permuted among themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
#: Fewer than a numbers lie outside, so up to n = 529 none needs more steps than this; above, one in 23^23 would, and raises.
MOST_STEPS = 23


def sides(n: int) -> tuple[int, int]:
    """a and b: a * b is at least n, and less than n + a."""
    a = max(1, math.isqrt(n - 1) + 1) if n > 0 else 1
    return a, max(1, -(-n // a))


def _drawn(seed: int, epoch: Column, k: Column, half: Column) -> Column:
    """A number below 2^32 by a hash of seed, epoch, round and half."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), k.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _walked(x: Column, n: int, once) -> Column:
    out = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_STEPS)), once(x), lambda y, _: F.when(y < n, y).otherwise(once(y)))
    # Bound by a lambda, so that it is computed once.
    checked = F.transform(F.array(out), lambda y: F.when(y < n, y).otherwise(F.raise_error(F.lit("a walk of the permutation didn't end"))))
    return F.when((x >= 0) & (x < n), F.get(checked, F.lit(0)))


def place_of(row: Column, n: int, seed: int, epoch: Column | int = 0) -> Column:
    """The place of a row in the shuffled order of an epoch; null for a row that isn't in 0..n-1."""
    a, b = sides(n)
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    rounds = F.array(*[F.lit(k) for k in range(ROUNDS)])

    def one(pair: Column, k: Column) -> Column:
        left, right = pair["left"], pair["right"]
        on_left = F.struct(((left + _drawn(seed, e, k, right)) % a).alias("left"), right.alias("right"))
        return F.when(k % 2 == 0, on_left).otherwise(F.struct(left.alias("left"), ((right + _drawn(seed, e, k, left)) % b).alias("right")))

    def once(x: Column) -> Column:
        begin = F.struct(F.floor(x / b).cast("long").alias("left"), (x % b).cast("long").alias("right"))
        return F.aggregate(rounds, begin, one, lambda p: p["left"] * b + p["right"])

    return _walked(row.cast("long"), n, once)


def row_at(place: Column, n: int, seed: int, epoch: Column | int = 0) -> Column:
    """The row at a place of the shuffled order of an epoch: the inverse of place_of."""
    a, b = sides(n)
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    rounds = F.array(*[F.lit(k) for k in reversed(range(ROUNDS))])

    def one(pair: Column, k: Column) -> Column:
        left, right = pair["left"], pair["right"]
        on_left = F.struct(F.pmod(left - _drawn(seed, e, k, right), F.lit(a)).alias("left"), right.alias("right"))
        return F.when(k % 2 == 0, on_left).otherwise(F.struct(left.alias("left"), F.pmod(right - _drawn(seed, e, k, left), F.lit(b)).alias("right")))

    def once(x: Column) -> Column:
        begin = F.struct(F.floor(x / b).cast("long").alias("left"), (x % b).cast("long").alias("right"))
        return F.aggregate(rounds, begin, one, lambda p: p["left"] * b + p["right"])

    return _walked(place.cast("long"), n, once)
