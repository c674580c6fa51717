"""Linear recurrences over tokens in long form, without an array of a whole sequence or a task that sees one.

A block of a sequence is a range of positions. Blocks are scanned apart, as pairs of the last sum and the product of the
factors; these pairs, one a block, are a recurrence again, which gives what each block is handed; then each block's tokens
are emitted. So a sequence of any length lies on as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import linear_scan
from .advantage import register_estimator

#: Positions of a block.
BLOCK = 4096


def _blocks(df: DataFrame, key: str, pos: str, columns: list[str], reverse: bool, block: int) -> DataFrame:
    """A row a block: key, __b, which rises in the direction of the scan, and __t, its tokens in that direction."""
    at = F.floor(F.col(pos) / block).cast("long")
    rows = df.select(key, (-at if reverse else at).alias("__b"), F.struct((-F.col(pos) if reverse else F.col(pos)).alias("__o"), *columns).alias("__x"))
    return rows.groupBy(key, "__b").agg(F.sort_array(F.collect_list("__x")).alias("__t"))


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def _carried(blocks: DataFrame, key: str, levels: int) -> DataFrame:
    """blocks (key, __b, __y, __p: the arrays of their sums and products) with __given, what the block before ends with, all
    before it included. With more levels the blocks' ends are scanned in blocks themselves; else a sequence's ends are one array."""
    ends = blocks.select(key, F.col("__b").alias("block"), F.element_at("__y", -1).alias("s"), F.element_at("__p", -1).alias("p"))
    if levels > 1:
        turn = ends.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("block")) - 1)
        done = linear_recurrence(turn, key, "n", "s", F.col("p"), "y", levels=levels - 1)
        given = done.select(key, "block", F.lag("y").over(Window.partitionBy(key).orderBy("block")).alias("__given"))
    else:
        listed = ends.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block", "s", "p"))).alias("e"))
        sums = linear_scan(F.transform("e", _field("s")), F.transform("e", _field("p")))
        pairs = F.arrays_zip(F.transform("e", _field("block")).alias("block"), F.slice(F.concat(F.array(F.lit(0.0)), sums), F.lit(1), F.size("e")).alias("given"))
        given = listed.select(key, F.explode(pairs).alias("g")).select(key, F.col("g.block"), F.col("g.given").alias("__given"))
    given = given.withColumnRenamed(key, "__key")
    found = blocks.join(given, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__b") == F.col("block")))
    return found.withColumn("__given", F.coalesce("__given", F.lit(0.0))).drop("__key", "block")


def _scanned(blocks: DataFrame, key: str, x: str, f: str, levels: int) -> DataFrame:
    """blocks whose tokens have x and f, with __y, the sums with all that came before."""
    factors = F.transform("__t", _field(f))
    # The product of the factors is what a carried 1 becomes: the scan of zeros begun with it.
    product = linear_scan(F.transform("__t", lambda x, i: F.when(i == 0, x[f]).otherwise(F.lit(0.0))), factors)
    local = blocks.withColumn("__y", linear_scan(F.transform("__t", _field(x)), factors)).withColumn("__p", product)
    done = _carried(local, key, levels)
    return done.withColumn("__y", F.zip_with("__y", "__p", lambda y, p: F.when(F.col("__given") == 0, y).otherwise(y + p * F.col("__given"))))


def linear_recurrence(df: DataFrame, key: str, pos: str, x: str, factor: Column | float, out: str = "y", reverse: bool = False, block: int = BLOCK, levels: int = 1) -> DataFrame:
    """df with out: y_t = x_t + f_t y_(t-1) along pos within each key, or, in reverse, y_t = x_t + f_t y_(t+1).

    pos is a whole number and unique within a key; it may have gaps, which are passed over. A factor of 0 begins anew. A null
    x or factor counts as 0; a null key is a sequence too; an empty table gives none. Other columns are kept. levels is how often blocks are scanned
    in blocks: with 1 a sequence may have some 10^9 tokens, as the ends of its blocks are one array, each more level takes BLOCK times as many.
    """
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    kept = [c for c in df.columns if c not in (key, out)]
    rows = df.select(key, *kept, F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias("__v"), F.coalesce(factor.cast("double"), F.lit(0.0)).alias("__f"))
    done = _scanned(_blocks(rows, key, pos, [*kept, "__v", "__f"], reverse, block), key, "__v", "__f", levels)
    flat = done.select(key, F.explode(F.arrays_zip("__t", "__y")).alias("__z"))
    return flat.select(*[F.col(key) if c == key else F.col(f"__z.__t.{c}").alias(c) for c in df.columns if c != out], F.col("__z.__y").alias(out))


def whiten_tokens(tokens: DataFrame, column: str, valid: Column | None = None, eps: float = 1e-8) -> DataFrame:
    """Values less their mean, over the root of their unbiased variance, of all rows, or of those that are valid; the others get 0. See advantage.whiten."""
    valid = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    x = F.when(valid, F.col(column))
    row = tokens.agg(F.struct(F.sum(x).alias("s"), F.count(x).cast("double").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).alias("all")).scalar()
    n, mean = row["n"], row["s"] / (row["n"] + F.lit(eps))
    variance = n * (row["v"] + (row["m"] - mean) * (row["m"] - mean)) / (n + F.lit(eps))
    scale = F.lit(1.0) / F.sqrt(F.when(n > 1, variance * n / (n - 1)).otherwise(variance) + F.lit(eps))
    return tokens.withColumn(column, F.when(valid, (F.col(column) - mean) * scale).otherwise(0.0))


@register_estimator("gae_tokens")
def gae_tokens(tokens: DataFrame, key: str = "row_id", pos: str = "pos", reward: str = "reward", value: str = "value", gamma: float = 1.0, lam: float = 0.95, block: int = BLOCK) -> DataFrame:
    """tokens with advantages (whitened) and returns (before whitening), as advantage.gae gives them for arrays. pos is unique within
    key; the value after a sequence's last token is 0."""
    rows = tokens.select(*[c for c in tokens.columns if c not in ("advantages", "returns")])
    blocks = _blocks(rows, key, pos, [c for c in rows.columns if c != key], True, block)
    # The block that is next in the text is the one before in the scan; only its first value is passed on.
    own = blocks.select(F.col(key).alias("__key"), F.col("__b").alias("__at"), F.element_at("__t", -1)[value].alias("__first"))
    own = own.withColumn("__first", F.lag("__first").over(Window.partitionBy("__key").orderBy("__at")))
    blocks = blocks.join(own, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__b") == F.col("__at"))).drop("__key", "__at")
    follow = F.concat(F.array(F.coalesce("__first", F.lit(0.0))), F.transform("__t", _field(value)))
    delta = F.zip_with("__t", F.slice(follow, F.lit(1), F.size("__t")), lambda t, v: t[reward] + gamma * v - t[value])
    delta = F.transform(delta, lambda d: F.struct(d.alias("x"), F.lit(gamma * lam).alias("f")))
    done = _scanned(blocks.select(key, "__b", F.col("__t").alias("__rows"), delta.alias("__t")), key, "x", "f", 1)
    flat = done.select(key, F.explode(F.arrays_zip("__rows", "__y")).alias("__z"))
    kept = [F.col(key) if c == key else F.col(f"__z.__rows.{c}").alias(c) for c in rows.columns]
    out = flat.select(*kept, F.col("__z.__y").alias("advantages"))
    return whiten_tokens(out.withColumn("returns", F.col("advantages") + F.col(value)), "advantages")


@register_estimator("reinforce_plus_plus_tokens")
def reinforce_plus_plus_tokens(tokens: DataFrame, key: str = "row_id", pos: str = "pos", reward: str = "reward", mask: str | None = None, gamma: float = 1.0, block: int = BLOCK) -> DataFrame:
    """tokens with returns, discounted from the end, and advantages, the returns whitened. With mask a token whose mask is 0 counts for
    nothing: it hands nothing to those before it, and has return and advantage 0."""
    m = F.lit(1.0) if mask is None else (F.col(mask) > 0).cast("double")
    rows = tokens.withColumn("__r", F.col(reward) * m)
    done = linear_recurrence(rows, key, pos, "__r", gamma * m, "returns", reverse=True, block=block).drop("__r")
    return whiten_tokens(done.withColumn("advantages", F.col("returns")), "advantages", m > 0)
