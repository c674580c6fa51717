"""Best-fit packing of token sequences by exact-complement hashing over a histogram of lengths."""

from __future__ import annotations

import functools
import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shuffle_parts
from .items import map_arrow

CAPACITY = 1024
END_ID = 2
#: Rows of one length that are numbered in one group.
RANK_GROUP = 50_000
_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


# ---- tokens


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """A function from a text to its ids as the tokenizer file gives them (add_special_tokens=False).

    Byte-level BPE files whose ids follow their merges are run by tiktoken, which gives the same ids several
    times faster; texts that hold the string of a special token, and other files, go through tokenizers.
    """
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    spec = json.loads(plain.to_str())
    slow = lambda text: plain.encode(text, add_special_tokens=False).ids
    pre, vocab = spec.get("pre_tokenizer") or {}, spec["model"].get("vocab")
    special = [x["content"] for x in spec.get("added_tokens", [])]
    merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"].get("merges", [])]
    follows = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    if not follows:
        return slow
    import tiktoken

    # Printable bytes stand for themselves in such files, the others for 256, 257, ... in order.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in special}
    fast = tiktoken.Encoding("file", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: slow(text) if any(s in text for s in special) else fast(text)


def token_pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A null text is an empty one, whose only id is
    end_id. Documents longer than capacity are cut so that only their first piece may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                first = (len(ids) - 1) % capacity + 1
                starts = [0, *range(first, len(ids), capacity)]
                for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    out.append((i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, cut, "id long, piece int, start long, length long, ids_crc32 long")


# ---- the plan, over counts of lengths only


class Sums:
    """Index of the sums of one, two and three available lengths. left has how often each length is available and only
    falls, so a combination that isn't available any more is passed over once and never looked at again."""

    def __init__(self, left: np.ndarray):
        self.left, self.capacity = left, len(left) - 1
        self._pairs: dict[int, list[int]] = {}
        self._triples: dict[int, int] = {}

    def _of_two(self, total: int) -> list[int]:
        """The smaller parts of the pairs that sum to total, the least available first, so that the most available is at the end."""
        if total not in self._pairs:
            low = np.arange(max(1, total - self.capacity), total // 2 + 1)
            both = np.minimum(self.left[low], self.left[total - low])
            low, both = low[both > 0], both[both > 0]
            self._pairs[total] = low[np.argsort(both, kind="stable")].tolist()
        return self._pairs[total]

    def _has(self, *parts: int) -> bool:
        return all(self.left[x] >= parts.count(x) for x in parts)

    def pair(self, total: int, most: int, beside: int = 0) -> list[int] | None:
        """Two lengths of at most most that sum to total, available besides a third, if given."""
        found = self._of_two(total)
        while found and not self._has(found[-1], total - found[-1]):
            found.pop()
        for low in reversed(found):
            parts = [total - low, low]
            if parts[0] <= most and self._has(*parts, *[beside] * (beside > 0)):
                return parts
        return None

    def exact(self, gap: int) -> list[int] | None:
        """Up to three available lengths that fill gap exactly: one, else the most available pair, else a triple with the longest first."""
        if gap <= self.capacity and self.left[gap]:
            return [gap]
        if found := self.pair(gap, gap):
            return found
        for a in range(self._triples.get(gap, min(gap - 2, self.capacity)), (gap + 2) // 3 - 1, -1):
            self._triples[gap] = a
            if self.left[a] and (found := self.pair(gap - a, a, a)):
                return [a, *found]
        self._triples[gap] = 0
        return None


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one sequence, number of such sequences) that use every length as often as it occurs.

    From the longest down, each length goes with combinations of one to three lengths that fill its sequence exactly, as often
    as the counts of all members allow. What is left of it goes by best fit: as many as a sequence holds, then
    exact combinations for the gap or else the longest length that fits, and so on. Works on the histogram, so its
    cost doesn't grow with the rows.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    sums = Sums(left)
    done: list[tuple[list[int], int]] = []

    def use(parts: list[int], most: int) -> int:
        k = min(most, *(int(left[x]) // c for x, c in Counter(parts).items()))
        for x in parts:
            left[x] -= k
        return k

    for top in range(capacity, 0, -1):
        while left[top]:
            left[top] -= 1  # one is in the sequence already
            add = sums.exact(capacity - top) if top < capacity else []
            left[top] += 1
            if add is None:
                break
            parts = [top, *add]
            done.append((parts, use(parts, int(left[top]))))
        while left[top]:
            fit = min(capacity // top, int(left[top]))
            begun = int(left[top]) // fit
            left[top] -= begun * fit
            open_ = [([top] * fit, capacity - top * fit, begun)]
            while open_:
                items, gap, n = open_.pop()
                add = sums.exact(gap) if gap else None
                if not add and gap:
                    fits = np.flatnonzero(left[: gap + 1])
                    add = [int(fits[-1])] if len(fits) else None
                if not add:
                    done.append((items, n))
                    continue
                k = use(add, n)
                if n > k:
                    open_.append((items, gap, n - k))
                open_.append((items + add, gap - sum(add), k))
    return done


def _slots(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: the rows of rank start.. go to sequences from base on, mult to each, the first at offset."""
    used: Counter = Counter()
    out, base = [], 0
    for items, n in patterns:
        offset = 0
        for length, mult in sorted(Counter(items).items(), reverse=True):
            out.append((length, used[length], mult, base, offset))
            used[length] += mult * n
            offset += mult * length
        base += n
    rows = np.array(sorted(out), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "start", "mult", "base", "offset"), rows.T))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (id, piece, start, length, ids_crc32) with sequence_id and offset added.

    Lengths must lie between 1 and capacity. The histogram of lengths (at most capacity rows) comes to the driver
    and gives the plan; the rows are numbered within (length, group) where groups grow in number with the rows,
    so that a length that most rows have is split, and find their place by that number. Rows that are equal in
    all columns are interchangeable. An empty table gives an empty result.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = _slots(plan_packing(counts, capacity))
    total = sum(counts.values())
    groups = max(2 * shuffle_parts(pieces.sparkSession), -(-total // RANK_GROUP))
    grouped = pieces.withColumn("__g", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)))
    before = grouped.groupBy("length", "__g").count()
    before = before.withColumn("__before", F.sum("count").over(Window.partitionBy("length").orderBy("__g")) - F.col("count")).drop("count")
    ranked = grouped.withColumn("__n", F.row_number().over(Window.partitionBy("length", "__g").orderBy("id", "piece", "start", "ids_crc32")))
    ranked = ranked.join(before, ["length", "__g"]).withColumn("rank", F.col("__before") + F.col("__n") - 1)
    keys = slots["length"] << 42 | slots["start"] if len(slots["length"]) else np.zeros(0, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 42 | rank, side="right") - 1
            turn = rank - slots["start"][at]
            sequence = slots["base"][at] + turn // slots["mult"][at]
            offset = slots["offset"][at] + turn % slots["mult"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    names = ["id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*names, "rank").mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Token pieces of every document of df and their places in sequences of at most capacity tokens.

    Returns id_col, piece, start, length, ids_crc32, sequence_id, offset. Rows with a null id are packed like the
    others; rows that repeat an id are documents of their own; other columns are not read.
    """
    pieces = materialise(token_pieces(df, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    return pack(pieces, capacity).withColumnRenamed("id", id_col)
