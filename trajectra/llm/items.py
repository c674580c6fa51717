"""Hashed words of blocks of documents, and packed arrays, which shuffle as a few bytes an item instead of a row each."""

from __future__ import annotations

import ctypes
import functools
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, shuffle_parts

#: Bytes of text of which a map task makes one block, and of which there is one bucket at least.
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
_STEP = 1 << 20
_SPACES = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def combine(*parts: np.ndarray) -> np.ndarray:
    """A hash of several hashes in their order."""
    out = np.zeros(len(parts[0]), np.uint64)
    for i, p in enumerate(parts):
        out += p * np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) & 0xFFFFFFFFFFFFFFFF | 1)
    return mix(out)


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, int, int]:
    rng = np.random.default_rng(20240229)
    letters = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)
    letters[65:91] = letters[97:123]  # A-Z count as a-z
    space = np.zeros(256, bool)
    space[list(_SPACES)] = True
    return letters, space, 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    _, _, r, inverse = _tables()
    up, down = np.full(n, r, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _hash_run(raw: bytes) -> np.ndarray:
    """Hashes of the words of raw, in order."""
    letters, space, _, _ = _tables()
    b = np.frombuffer(raw, np.uint8)
    gap = space[b]
    edge = np.diff(np.concatenate([[True], gap, [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(max(2 * _STEP, 1 << len(b).bit_length()))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(letters[b] * up[: len(b)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and how many each text has. Words are runs without
    space, tab, line feed, vertical tab, form feed or carriage return; A-Z count as a-z."""
    out, counts = [], np.zeros(len(texts), np.int64)
    group: list[bytes] = []
    held, first = 0, 0

    def flush(upto: int) -> None:
        nonlocal group, held, first
        if group:
            raw = b" ".join(group)
            out.append(_hash_run(raw))
            # The words of each text are told by counting those that begin before its end.
            _, space, _, _ = _tables()
            gap = space[np.frombuffer(raw, np.uint8)]
            begins = np.concatenate([[True], gap])[:-1] & ~gap if len(raw) else np.zeros(0, bool)
            before = np.concatenate([[0], np.cumsum(begins)])
            ends = np.cumsum([len(t) + 1 for t in group]) - 1
            counts[first:upto] = np.diff(np.concatenate([[0], before[ends]]))
        group, held, first = [], 0, upto

    for i, text in enumerate(texts):
        if len(text) > 2 * _STEP:  # a long text goes by itself, in runs that end at a space
            flush(i)
            at = 0
            while at < len(text):
                end = min(len(text), at + _STEP)
                while end < len(text) and text[end] not in _SPACES:
                    end += 1
                out.append(_hash_run(text[at:end]))
                counts[i] += len(out[-1])
                at = end
            first = i + 1
            continue
        group.append(text)
        held += len(text) + 1
        if held >= _STEP:
            flush(i + 1)
    flush(len(texts))
    return np.concatenate(out) if out else np.zeros(0, np.uint64), counts


@dataclass
class Block:
    """Some rows of a partition. key is the same whenever the partition is computed again."""

    key: int
    columns: dict[str, list]
    texts: list[bytes]


def home(block: int, n: int) -> int:
    """The bucket that a block's own row goes to: its key is mixed, as partitions and their blocks are numbered in a row."""
    return int(mix(np.array([block], np.uint64))[0] % np.uint64(n))


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """Buckets of hashes: n ranges of the hash space in order, so that sorted hashes lie in sorted buckets."""
    if n <= 1 << 16:
        return ((key >> np.uint64(48)) * np.uint64(n) >> np.uint64(16)).astype(np.int64)
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def bucket_start(bucket, n: int) -> np.ndarray:
    """The least hash of a bucket; a hash less this takes as many bytes less as there are buckets for, and gives it back."""
    bits = 16 if n <= 1 << 16 else 32
    first = ((np.asarray(bucket, np.uint64) << np.uint64(bits)) + np.uint64(n - 1)) // np.uint64(n)
    return first << np.uint64(64 - bits)


def add(out: list[list], *row) -> None:
    for column, value in zip(out, row):
        column.append(value)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK_BYTES) -> Iterator[Block]:
    part, seq = TaskContext.get().partitionId(), 0
    columns: dict[str, list] = {}
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for name in batch.schema.names:
            if name != text:
                columns.setdefault(name, []).extend(batch.column(name).to_pylist())
        values = batch.column(text).cast(pa.large_binary())
        done = batch.num_rows
        for n, value in enumerate(values):
            raw = value.as_py() or b""
            texts.append(raw)
            held += len(raw)
            if held >= size and n + 1 < done:
                k = len(texts)
                yield Block(part << 24 | seq, {c: v[:k] for c, v in columns.items()}, texts)
                columns, texts, held, seq = {c: v[k:] for c, v in columns.items()}, [], 0, seq + 1
        if held >= size:
            yield Block(part << 24 | seq, columns, texts)
            columns, texts, held, seq = {}, [], 0, seq + 1
    if texts:
        yield Block(part << 24 | seq, columns, texts)


# ---- packed arrays

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers, each in the fewest bytes that hold its largest, or of doubles."""
    out = [struct.pack("<B", len(arrays))]
    for a in arrays:
        if a.dtype == np.float64:
            out.append(struct.pack("<BI", 0, len(a)) + a.astype("<f8").tobytes())
            continue
        size = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        if size in (1, 2, 4, 8):
            data = a.astype(f"<u{size}").tobytes()
        else:
            data = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()
        out.append(struct.pack("<BI", size, len(a)) + data)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 1
    for _ in range(data[0]):
        size, n = struct.unpack_from("<BI", data, at)
        at += 5
        if size == 0:
            out.append(np.frombuffer(data, "<f8", n, at))
            at += 8 * n
            continue
        if size in (1, 2, 4, 8):
            out.append(np.frombuffer(data, f"<u{size}", n, at).astype(np.uint64))
        else:
            wide = np.zeros((n, 8), np.uint8)
            wide[:, :size] = np.frombuffer(data, np.uint8, size * n, at).reshape(-1, size)
            out.append(wide.reshape(-1).view("<u8"))
        at += size * n
    return out


def steps(keys: np.ndarray) -> np.ndarray:
    """A sorted array as its first value and the steps between its values, which take fewer bytes; cumsum undoes it."""
    out = keys.copy()
    out[1:] -= keys[:-1]
    return out


def pack_counts(counts: np.ndarray) -> list[np.ndarray]:
    """Counts most of which are 1, as the places and values of the others."""
    more = np.flatnonzero(counts != 1)
    return [more.astype(np.uint64), counts[more].astype(np.uint64)]


def unpack_counts(n: int, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.ones(n, np.int64)
    out[places.astype(np.int64)] = values
    return out


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a sorted array and how often each occurs."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.concatenate([first, [len(values)]]))


def pack_small(counts: np.ndarray) -> list[np.ndarray]:
    """Counts most of which are below 255: a byte each, and the others again."""
    return [np.minimum(counts, 255).astype(np.uint64), counts[counts >= 255].astype(np.uint64)]


def unpack_small(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(np.int64)
    out[out == 255] = large
    return out


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the items of each bucket that has any, in their order. Takes as long as there are items, however many buckets there are."""
    order = np.argsort(bucket, kind="stable")
    names, sizes = runs(bucket[order])
    ends = np.cumsum(sizes)
    for b, begin, end in zip(names.tolist(), (ends - sizes).tolist(), ends.tolist()):
        yield b, order[begin:end]


def in_buckets(keys: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """The stretch of sorted keys that lies in each bucket that has any."""
    names, sizes = runs(bucket_of(keys, n))
    ends = np.cumsum(sizes)
    for b, begin, end in zip(names.tolist(), (ends - sizes).tolist(), ends.tolist()):
        yield b, slice(begin, end)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the place of each key among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = ranked[1:] != ranked[:-1]
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(first) - 1
    return ranked[first], at


def bucket_count(df: DataFrame, text: str) -> int:
    """Buckets for what the texts of df hold: in number with the texts, so that none grows with them."""
    total = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(shuffle_parts(df.sparkSession), -(-total // BUCKET_BYTES))


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) by workers that give the memory of their arrays back when a task ends."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    prepare(df.sparkSession)
    return df.mapInArrow(trimmed, schema)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
