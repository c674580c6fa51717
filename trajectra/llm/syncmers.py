"""Document fingerprints of closed syncmers, in DataFrame functions only.

The units are words; a word of more than LONG characters (text without spaces, an encoded line) counts as its
characters. A run of K units is an anchor if, of the runs of S units inside it, the one with the smallest hash stands
first or last. Whether a run is an anchor depends on nothing around it, so texts that share a passage share its
anchors, in the same order and at the same distances, whatever stands before and after. The fingerprint is the
hashes of the anchors in text order, eight hex digits each.

Fingerprints are compared by position: an anchor that both have counts if the one before it or after it, of those that both
have, stands before or after it in both and is displaced as far as it is, give or take SLACK places, that is, if it is part of a
shared passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_parts

K, S = 5, 2
LONG = 32
#: Places by which the displacements of neighbouring shared anchors may differ: what an edit of one word between them takes or adds.
SLACK = 5
#: Ids of one range of their order.
RANGE_IDS = 1_000_000
_SPACE = " \t\n\x0b\x0c\r"


def _units(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE))
    words = F.when(F.length(trimmed) > 0, F.split(trimmed, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>"))
    apart = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG, F.filter(F.split(w, ""), lambda c: c != "")).otherwise(F.array(w))))
    return F.when(trimmed.rlike(f"[^ \\t-\\r]{{{LONG + 1}}}"), apart).otherwise(words)


def with_anchors(df: DataFrame, text: str, out: str, positions: str | None = None) -> DataFrame:
    """df with out, array<int>: the anchors of column text in order; and with positions, if named, the unit that each
    begins at. A text of fewer than K units has its units instead, one of K units or more without an anchor all its
    runs of K units; a text without words, or null, has none."""
    units, hashes, inner, found = (f"__{out}_{x}" for x in ("u", "h", "s", "f"))
    df = df.withColumn(units, _units(F.col(text))).withColumn(hashes, F.transform(units, lambda w: F.xxhash64(w)))
    n = F.size(hashes)
    some = F.greatest(n - 1, F.lit(0))
    df = df.withColumn(inner, F.zip_with(F.slice(hashes, F.lit(1), some), F.slice(hashes, F.lit(2), some), lambda a, b: F.xxhash64(a, b)))
    s = F.col(inner)
    whole = lambda i: F.hash(F.get(s, i), F.get(s, i + 2), F.get(s, i + 3))

    def closed(i: Column) -> Column:
        a, b, c, d = (F.get(s, i + k) for k in range(K - S + 1))
        low = F.least(b, c)
        return (a <= low) & (a <= d) | (d <= low) & (d <= a)

    runs = F.sequence(F.lit(0), F.size(s) - (K - S + 1))
    if positions is None:
        chosen = F.array_compact(F.transform(runs, lambda i: F.when(closed(i), whole(i))))
        all_, few = F.transform(runs, whole), F.transform(hashes, lambda h: F.hash(h))
    else:
        pair = lambda i, h: F.struct(i.alias("at"), h.alias("hash"))
        chosen = F.array_compact(F.transform(runs, lambda i: F.when(closed(i), pair(i, whole(i)))))
        all_, few = F.transform(runs, lambda i: pair(i, whole(i))), F.transform(hashes, lambda h, i: pair(i, F.hash(h)))
    df = df.withColumn(found, F.when(n >= K, chosen))
    df = df.withColumn(out, F.when(n < K, few).when(F.size(found) > 0, F.col(found)).otherwise(all_))
    if positions is not None:
        df = df.withColumns({positions: F.transform(out, lambda x: x["at"]), out: F.transform(out, lambda x: x["hash"])})
    return df.drop(units, hashes, inner, found)


def as_text(anchors: str) -> Column:
    return F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """df with out: shared anchors that agree in position over all different anchors of two fingerprints, 0 to 1.

    An anchor that a fingerprint has several times counts once, at its first place. A single shared anchor counts if it isn't
    displaced by more than SLACK. Equal fingerprints have 1, empty ones too; an empty and another one have 0.
    """
    both, met = f"__{out}_b", f"__{out}_m"
    place = (1 << 30) - 1

    def side(x: str, mark: int) -> Column:
        return F.transform(F.array_distinct(x), lambda h, i: F.shiftleft(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)), 31).bitwiseOR(i.cast("long") + mark))

    # Hash, then side, then place: a hash that both sides have is two neighbours.
    df = df.withColumn(both, F.sort_array(F.concat(side(a, 0), side(b, 1 << 30))))
    some = F.greatest(F.size(both) - 1, F.lit(0))
    at = lambda x: x.bitwiseAND(F.lit(place))
    pairs = F.zip_with(F.slice(both, F.lit(1), some), F.slice(both, F.lit(2), some), lambda x, y: F.when(F.shiftright(x, 31) == F.shiftright(y, 31), F.shiftleft(at(x), 32).bitwiseOR(at(y))))
    df = df.withColumn(met, F.sort_array(F.array_compact(pairs)))
    moved = lambda m: m.bitwiseAND(F.lit(place)) - F.shiftright(m, 32)

    def agrees(m: Column, i: Column) -> Column:
        near = lambda x: F.abs(moved(m) - moved(x)) <= SLACK
        before, after = F.get(met, i - 1), F.get(met, i + 1)
        joins = F.coalesce((at(before) < at(m)) & near(before), F.lit(False)) | F.coalesce((at(after) > at(m)) & near(after), F.lit(False))
        return joins | (F.size(met) == 1) & (F.abs(moved(m)) <= SLACK)

    shared = F.size(F.filter(met, agrees))
    all_ = F.size(both) - shared
    alike = F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(shared / F.greatest(all_, F.lit(1)))
    return df.withColumn(out, alike).drop(both, met)


def next_in_order(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each different (id, text) of df: kid, kn (the id, and whether it is null), h (hash of the text), n (characters),
    copies, and the same of the one that comes next (next_kid, next_kn, next_h): by descending id, nulls last,
    then by the texts' hashes; after the last the first. Only ids and hashes move.

    Ranges of the order are written once, each with its number, so what follows reads the same ranges; a range is numbered in a
    task, and the last of each is followed by the first of the next, of which there are as many as ranges.
    """
    ids = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ids = ids.select("id", F.xxhash64("t").alias("h"), F.length("t").cast("long").alias("n")).groupBy("id", "h", "n").agg(F.count(F.lit(1)).alias("copies"))
    ranges = max(shuffle_parts(df.sparkSession), -(-df.select(F.lit(1)).count() // RANGE_IDS))
    order = [F.col("id").desc_nulls_last(), F.desc("h"), F.desc("n")]
    ranged = materialise(ids.repartitionByRange(ranges, *order).withColumn("r", F.spark_partition_id()), "ids")
    # As a struct the greatest comes first; a null is the least of all.
    key = F.struct("id", "h", "n")
    firsts = ranged.groupBy("r").agg(F.max(key).alias("first"))
    turn = Window.orderBy("r")
    firsts = firsts.select(F.col("r").alias("__r"), F.coalesce(F.lead("first").over(turn), F.first("first").over(turn)).alias("after"))
    inside = Window.partitionBy("r").orderBy(*order)
    out = ranged.withColumn("next", F.lead(key).over(inside)).join(F.broadcast(firsts), F.col("r") == F.col("__r"))
    out = out.withColumn("next", F.coalesce("next", "after"))
    named = lambda x, to: [F.coalesce(x["id"], F.lit(0).cast("long")).alias(f"{to}kid"), x["id"].isNull().alias(f"{to}kn"), x["h"].alias(f"{to}h")]
    return out.select(*named(key, ""), "n", "copies", *named(F.col("next"), "next_"))


def with_neighbour(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, n (characters), anchors of every row of df, with next_anchors and next_part of the row that comes next by descending id (see
    next_in_order): the first floor(n / 2) characters of its text, or all. Rows that repeat an id and a text follow one another.

    Each text is sent once, to learn who it follows; then half of it at most and its anchors, to that row.
    """
    key = ["kid", "kn", "h"]
    order = next_in_order(df, id_col, text_col)
    follows = order.select(F.col("next_kid").alias("kid"), F.col("next_kn").alias("kn"), F.col("next_h").alias("h"), *[F.col(k).alias(f"to_{k}") for k in key], F.floor(F.col("n") / 2).cast("int").alias("need"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("id", F.lit(0).cast("long")).alias("kid"), F.col("id").isNull().alias("kn"), F.xxhash64("text").alias("h"), "text")
    # One of the rows that are equal, combined before they are sent.
    rows = rows.groupBy(*key).agg(F.first("text").alias("text"))
    guests = with_anchors(rows.join(follows, key), "text", "next_anchors")
    guests = guests.select(*[F.col(f"to_{k}").alias(k) for k in key], F.substr("text", F.lit(1), F.col("need")).alias("next_part"), "next_anchors")
    own = with_anchors(rows.join(order.select(*key, "n", "copies"), key), "text", "anchors")
    met = own.join(guests, key)
    # All but one of equal rows are followed by their like.
    once = F.struct(F.col("next_part").alias("part"), F.col("next_anchors").alias("anchors"), F.lit(1).cast("long").alias("times"))
    like = F.struct(F.substr("text", F.lit(1), F.floor(F.col("n") / 2).cast("int")).alias("part"), F.col("anchors").alias("anchors"), (F.col("copies") - 1).alias("times"))
    met = met.withColumn("x", F.explode(F.when(F.col("copies") > 1, F.array(once, like)).otherwise(F.array(once))))
    return met.select(F.when(~F.col("kn"), F.col("kid")).alias("id"), "text", "n", "anchors", F.col("x.part").alias("next_part"), F.col("x.anchors").alias("next_anchors"), F.col("x.times").alias("times"))


def compare_edited(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of df.

    The edited text is the row's with its last floor(n_chars / 2) characters replaced by the first as many of the next row's
    (see with_neighbour). A null text is empty; null ids and repeated ids and rows are rows like others; an only row follows itself;
    an empty table gives none. Other columns are not read.
    """
    rows = with_neighbour(df, id_col, text_col)
    kept = F.substr("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 2)).cast("int"))
    rows = with_anchors(rows.withColumn("edited", F.concat(kept, "next_part")), "edited", "edited_anchors")
    rows = with_likeness(with_likeness(rows, "anchors", "edited_anchors", "near_edited"), "anchors", "next_anchors", "near_next")
    rows = rows.select(F.col("id").alias(id_col), F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), as_text("anchors").alias("fingerprint"), as_text("edited_anchors").alias("edited_fingerprint"), "near_edited", "near_next", "times")
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, its text's anchors (array<int>), the units that they begin at (positions) and its fingerprint (string), one row per
    row of df, repeated ids too. Texts with more anchors in common at like distances are likelier copies (with_likeness)."""
    rows = df.select(F.col(id_col), F.col(text_col).alias("__text"))
    return with_anchors(rows, "__text", "anchors", "positions").select(id_col, "anchors", "positions", as_text("anchors").alias("fingerprint"))
