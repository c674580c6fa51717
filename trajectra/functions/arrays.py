"""Ragged token arrays: masks, padding, truncation, positions, scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_prefix(ids: Column, length: Column) -> Column:
    return F.slice(ids, F.lit(1), F.greatest(length, F.lit(0)))


def eos_mask(ids: Column, eos: int) -> Column:
    """1 up to and with the first eos, then 0."""
    first = F.array_position(ids, F.lit(eos))
    return F.transform(ids, lambda x, i: F.when((first == 0) | (i < first), 1).otherwise(0))


def pad(values: Column, n: int, fill, left: bool = False) -> Column:
    more = F.array_repeat(F.lit(fill), F.greatest(F.lit(n) - F.size(values), F.lit(0)))
    return F.concat(more, values) if left else F.concat(values, more)


def truncate(values: Column, n: int, side: str = "right") -> Column:
    """At most n values: the first with side right, the last with side left; with error, more than n raise."""
    size = F.size(values)
    if side == "right":
        return F.slice(values, 1, n)
    if side == "left":
        return F.slice(values, F.greatest(F.lit(1), size - n + 1), F.lit(n))
    if side == "error":
        return F.when(size <= n, values).otherwise(F.raise_error(F.concat(F.lit("sequence of "), size.cast("string"), F.lit(f" values, {n} allowed"))))
    raise ValueError(f"side is right, left or error, not {side}")


def position_ids(mask: Column) -> Column:
    """How many valid places there are up to each, less one, 0 at least."""
    running = linear_scan(F.transform(mask, lambda x: x.cast("double")), 1.0)
    return F.transform(running, lambda x: F.greatest(x.cast("bigint") - 1, F.lit(0).cast("long")))


def continue_positions(positions: Column, n: Column) -> Column:
    last = F.element_at(positions, -1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: last + i)).otherwise(F.array().cast("array<bigint>"))


def next_value(values: Column, i: Column) -> Column:
    return F.coalesce(F.get(values, i + 1), F.lit(0.0))


def shifted(values: Column, fill) -> Column:
    """Each place has the value of the next one, the last has fill: the labels that a sequence's tokens are to predict."""
    return F.when(F.size(values) > 0, F.concat(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.array(F.lit(fill)))).otherwise(values)


#: Fixed value: the id of the token that stands for a piece of an image.
VISION_TOKEN = 151655


def has_token(ids: Column, token: int = VISION_TOKEN) -> Column:
    return F.array_contains(ids, F.lit(token).cast("long"))


def _let(value: Column, use) -> Column:
    """use(value), where value is computed once: what a lambda's body names from outside is computed at every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Values of a block of a scan. A block's sums are appended one by one, which copies them, so blocks are short.
SCAN_BLOCK = 64


def linear_scan(values: Column, factors: Column | float) -> Column:
    """y_t = x_t + f_t * y_(t-1), from y = 0 before the first: factors are an array as long as values, or one number.

    Blocks of SCAN_BLOCK values are scanned each by itself, as pairs of the sum and the product of the factors so far; then
    what a block carries to the next; then each sum is added to its factor times what its block is given. So time grows
    with the length and not with its square, until the blocks themselves are many thousands. A null value makes it and those after it null.
    """
    pair = lambda x, f: F.struct(x.alias("x"), f.alias("f"))
    if isinstance(factors, Column):
        items = F.zip_with(values, factors, lambda x, f: pair(x, f.cast("double")))
    else:
        items = F.transform(values, lambda x: pair(x, F.lit(float(factors))))
    none = F.array().cast("array<struct<s:double,p:double>>")

    def extended(done: Column, item: Column) -> Column:
        last = F.element_at(done, -1)
        first = F.struct(item["x"].cast("double").alias("s"), item["f"].alias("p"))
        return F.concat(done, F.array(F.when(F.size(done) == 0, first).otherwise(F.struct((item["x"] + item["f"] * last["s"]).alias("s"), (item["f"] * last["p"]).alias("p")))))

    def cut(items: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / SCAN_BLOCK), F.lit(0)).cast("int"))
        return F.transform(places, lambda i: F.aggregate(F.slice(items, i * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK)), none, extended))

    def given(done: Column, block: Column) -> Column:
        end = F.element_at(block, -1)
        return F.concat(done, F.array(end["s"] + end["p"] * F.element_at(done, -1)))

    def joined(blocks: Column) -> Column:
        # What each block is given by those before it; the last entry is what the last block carries on.
        return _let(F.aggregate(blocks, F.array(F.lit(0.0)), given), lambda carried: F.flatten(F.zip_with(blocks, F.slice(carried, F.lit(1), F.size(blocks)), lambda block, c: F.transform(block, lambda x: x["s"] + x["p"] * c))))

    out = _let(items, lambda given_items: _let(cut(given_items), joined))
    return F.when(F.size(values) > 0, out).when(F.size(values) == 0, F.array().cast("array<double>"))


def reverse_scan(values: Column, factor: Column | float) -> Column:
    """s_t = x_t + f_t * s_(t+1); see linear_scan."""
    turned = F.reverse(factor) if isinstance(factor, Column) else factor
    return F.reverse(linear_scan(F.reverse(values), turned))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def masked_row_mean(values: Column, mask: Column, eps: float = 1e-8) -> Column:
    top = total(F.zip_with(values, mask, lambda x, m: x * m))
    return top / (F.aggregate(mask, F.lit(0.0), lambda a, m: a + m) + F.lit(eps))


def log_softmax_at(logits: Column, label: Column) -> Column:
    top = F.array_max(logits)
    return F.get(logits, label) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def segment_lengths(positions: Column) -> Column:
    """Lengths of the sequences packed in one, each of which begins where position is 0."""
    starts = F.filter(F.transform(positions, lambda p, i: F.when(p == 0, i)), lambda x: x.isNotNull())
    return F.transform(starts, lambda s, k: F.coalesce(F.get(starts, k + 1), F.size(positions)) - s)
