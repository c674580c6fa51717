"""Encoding and decoding by a SentencePiece model of merges, in vectorised rounds over flat arrays of symbols.

The texts of an Arrow batch are one array of characters. It is cut wherever no piece of the model holds the two characters
on either side of the cut, so no merge ever crosses one; what lies between is a word. Words that occur more often in a batch are
merged once. In a round every word's least pair rank is found by a segmented minimum, its occurrences are merged from the
left, and the arrays are compacted; a word without any pair leaves them.
"""

from __future__ import annotations

import codecs
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .items import map_arrow

SPACE = "▁"
#: Longer words are cut into blocks of so many symbols, each with a minimum of its own.
BLOCK = 64
_NONE = np.iinfo(np.int32).max
_ODD = np.uint64(0x9E3779B97F4A7C15)

codecs.register_error("trajectra-each-byte", lambda e: ("�" * (e.end - e.start), e.end))


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] numbers), then those from starts[1] on, and so on."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class PieceModel:
    """The tables of a model file. Takes models that merge (BPE) with byte fallback, the identity as normalisation and no
    symbols of the user's or unused pieces; raises ValueError for others.

    A symbol is a piece's id, or from n_pieces on a character that only stands within pieces, or n_symbols plus the code
    point of any other character.
    """

    def __init__(self, path: str):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = list(_fields(own.serialized_model_proto()))
        trainer, normal = (dict(_fields(next((v for f, v in spec if f == k), b""))) for k in (2, 3))
        kinds = np.array([dict(_fields(v)).get(3, 1) for f, v in spec if f == 1])
        # Fixed values of the format: kinds of pieces are 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte.
        if trainer.get(3, 1) != 2 or not trainer.get(35) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or trainer.get(24) or np.isin(kinds, (4, 5)).any():
            raise ValueError(f"{path}: not a model of merges with byte fallback, identity normalisation and normal pieces only")
        self.prefix = bool(normal.get(3, 1))
        pieces = [own.id_to_piece(i) for i in range(own.get_piece_size())]
        self.n_pieces = len(pieces)
        merged = {p: i for i, p in enumerate(pieces) if kinds[i] == 1}
        symbols = dict(merged)
        for c in sorted({c for p in merged for c in p} - symbols.keys()):
            symbols[c] = self.n_pieces + len(symbols) - len(merged)
        self.n_symbols = self.n_pieces + len(symbols) - len(merged)
        self.outside = np.array([ord(c) for c, i in symbols.items() if i >= self.n_pieces], np.int64)
        self._characters(merged, symbols)
        self._pairs(merged, symbols, [own.get_score(i) for i in range(self.n_pieces)])
        self._surfaces(pieces, kinds, trainer)

    def _characters(self, merged: dict[str, int], symbols: dict[str, int]) -> None:
        chars = sorted({c for p in merged for c in p})
        number = {c: i for i, c in enumerate(chars)}
        self.number = np.full(0x110000, len(chars), np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(len(chars))
        self.symbol = np.array([symbols[c] for c in chars] + [-1], np.int64)
        self.wide = len(chars) + 1
        inside = {number[a] * self.wide + number[b] for p in merged for a, b in zip(p, p[1:])}
        bits = np.zeros(self.wide * self.wide // 8 + 1, np.uint8)
        at = np.array(sorted(inside), np.int64)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.inside = bits
        self.longest = max(map(len, merged), default=1)

    def _pairs(self, merged: dict[str, int], symbols: dict[str, int], scores: list[float]) -> None:
        found = [(symbols[p[:k]] * self.n_symbols + symbols[p[k:]], i) for p, i in merged.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        keys, values = np.array(found, np.int64).reshape(-1, 2).T
        bits = max(4, (4 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self._keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self._keys[slot[put]], self._values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self._mask
        # Equal scores share a rank; the last entry is that of no pair.
        self.rank = np.append(np.unique(-np.array(scores), return_inverse=True)[1], _NONE).astype(np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _ODD >> self._shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols merges to, or -1."""
        # A character outside all pieces is in no pair; its symbol is too large for a key of its own.
        keys = left.astype(np.int64) * self.n_symbols + right
        keys[(left >= self.n_symbols) | (right >= self.n_symbols)] = -2
        slot = self._slot(keys)
        there = self._keys[slot]
        out = np.where(there == keys, self._values[slot], -1)
        rest = np.flatnonzero((there != keys) & (there != -1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & self._mask
            there = self._keys[slot[rest]]
            hit = there == keys[rest]
            out[rest[hit]] = self._values[slot[rest[hit]]]
            rest = rest[~hit & (there != -1)]
        return out

    def _surfaces(self, pieces: list[str], kinds: np.ndarray, trainer: dict) -> None:
        unknown = trainer.get(44, b" \xe2\x81\x87 ")
        of = [unknown if k == 2 else b"" if k == 3 else bytes([int(p[3:5], 16)]) if k == 6 else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds)]
        self.surface = np.frombuffer(b"".join(of), np.uint8)
        self.surface_size = np.array([len(x) for x in of], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.begins_with_space = np.array([k == 1 and p.startswith(SPACE) for p, k in zip(pieces, kinds)])
        self.byte_id = np.zeros(256, np.int32)
        for i, (p, k) in enumerate(zip(pieces, kinds)):
            if k == 6:
                self.byte_id[int(p[3:5], 16)] = i

    def normalise(self, text: str | None) -> str:
        text = text or ""
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


# ---- encoding


def merge_rounds(model: PieceModel, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of words (sizes[i] of them for word i) when no pair is left, and how many each word has.

    A word's occurrences of its least pair are merged in one round only if no pair that arises from one of them ranks before, or
    beside, those after it; else the first alone is. In a word of several blocks each block merges its first least pair, if no
    pair of a neighbouring block that is near enough to reach it goes before.
    """
    word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    place, total = np.arange(len(symbols), dtype=np.int32), len(symbols)
    done = np.full(total, -1, np.int32)
    symbols = symbols.astype(np.int32)
    made = np.full(total, -1, np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    made[inner] = model.pairs(symbols[inner], symbols[inner + 1])
    rank = model.rank[made]
    while len(symbols):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        least = np.minimum.reduceat(rank, starts)
        if (least == _NONE).any():
            lengths = np.diff(np.append(starts, len(symbols)))
            more = np.repeat(least != _NONE, lengths)
            done[place[~more]] = symbols[~more]
            symbols, word, place, made, rank = (x[more] for x in (symbols, word, place, made, rank))
            continue
        lengths = np.diff(np.append(starts, len(symbols)))
        block_of_word = None
        if lengths.max() > BLOCK:
            number = -(-lengths // BLOCK)
            block_of_word = np.repeat(np.arange(len(starts)), number)
            starts = np.repeat(starts, number) + BLOCK * ranges(np.zeros(len(number), np.int64), number)
            least = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.append(starts, len(symbols)))
        chosen = _chosen(model, symbols, word, made, rank, starts, lengths, least, block_of_word)
        symbols[chosen] = made[chosen]
        stay = np.ones(len(symbols), bool)
        stay[chosen + 1] = False
        symbols, word, place, made, rank = (x[stay] for x in (symbols, word, place, made, rank))
        at = chosen - np.arange(len(chosen))
        new = np.zeros(len(symbols) + 1, bool)
        new[at] = new[at - 1] = True  # before the first stands the last place, which is cut off
        at = np.flatnonzero(new[:-1])
        pair = np.full(len(at), -1, np.int32)
        inner = np.flatnonzero(at + 1 < len(symbols))
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        pair[inner] = model.pairs(symbols[at[inner]], symbols[at[inner] + 1])
        made[at], rank[at] = pair, model.rank[pair]
    left = np.add.reduceat(done >= 0, np.cumsum(sizes) - sizes) if total else np.zeros(0, np.int64)
    return done[done >= 0], left


def _chosen(model, symbols, word, made, rank, starts, lengths, least, block_of_word) -> np.ndarray:
    """Where this round merges: the places of left symbols, ascending."""
    chosen = np.flatnonzero((rank == np.repeat(least, lengths)) & (rank != _NONE))
    block = np.searchsorted(starts, chosen, side="right") - 1
    # Of pairs that overlap, every second one.
    run = np.append(True, (chosen[1:] != chosen[:-1] + 1) | (block[1:] != block[:-1]))
    first = np.maximum.accumulate(np.where(run, chosen, 0))
    keep = (chosen - first) % 2 == 0
    chosen, block = chosen[keep], block[keep]
    head = np.append(True, block[1:] != block[:-1])
    alone = np.zeros(len(starts), bool)
    if block_of_word is not None:
        own = block_of_word
        alone = np.append(own[1:] == own[:-1], False) | np.append(False, own[1:] == own[:-1])
        before, after = np.append(False, own[1:] == own[:-1]), np.append(own[1:] == own[:-1], False)
        left, right = np.append(_NONE, least[:-1]), np.append(least[1:], _NONE)
        near_left = chosen - starts[block] < model.longest
        near_right = starts[block] + lengths[block] - 2 - chosen < model.longest
        blocked = before[block] & near_left & (left[block] <= least[block]) | after[block] & near_right & (right[block] < least[block])
        chosen, block, head = chosen[~(alone[block] & (~head | blocked))], block[~(alone[block] & (~head | blocked))], None
        head = np.append(True, block[1:] != block[:-1])
    early = np.flatnonzero(~np.append(head[1:], True))  # others of the same block follow
    if len(early):
        at = chosen[early]
        back = np.maximum(at - 1, 0)
        joined = (early > 0) & (chosen[early - 1] == at - 2)
        previous = np.where(joined, made[np.maximum(at - 2, 0)], symbols[back])
        before = np.where((at > 0) & (word[back] == word[at]), model.pairs(previous, made[at]), -1)
        behind = model.pairs(made[at], symbols[at + 2])
        unsafe = np.minimum(model.rank[before], model.rank[behind]) <= rank[at]
        alone[block[early[unsafe]]] = True
    return chosen[head | ~alone[block]]


def encode(model: PieceModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, one after another, and how many each text has."""
    texts = [model.normalise(t) for t in texts]
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    number = model.number[code]
    key = number[:-1].astype(np.int64) * model.wide + number[1:]
    cut = np.append(True, model.inside[key >> 3] >> (key & 7).astype(np.uint8) & 1 == 0)
    ends = np.cumsum([len(t) for t in texts])
    cut[(ends - [len(t) for t in texts])[[len(t) > 0 for t in texts]]] = True
    starts = np.flatnonzero(cut)
    sizes = np.diff(np.append(starts, len(code)))
    word_starts, word_sizes, which = _distinct(code, starts, sizes)
    at = ranges(word_starts, word_sizes)
    symbols = model.symbol[number[at]]
    ids, counts = merge_rounds(model, np.where(symbols < 0, model.n_symbols + code[at], symbols), word_sizes)
    ids, counts = _with_bytes(model, ids, counts)
    first = np.cumsum(counts) - counts
    out = ids[ranges(first[which], counts[which])]
    upto = np.append(0, np.cumsum(counts[which]))[np.searchsorted(starts, ends)]
    return out, np.diff(np.append(0, upto))


def _distinct(code: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the different words, and which of them each word is. Words are found by a hash and compared."""
    within = ranges(np.zeros(len(starts), np.int64), sizes)
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(sizes.max()), np.uint64(0xD1342543DE82EF95))))
    letter = (code.astype(np.uint64) + np.uint64(1)) * _ODD
    letter ^= letter >> np.uint64(29)
    hashed = np.add.reduceat(letter * power[within], starts)
    _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
    like = np.minimum(np.repeat(starts[first[which]], sizes) + within, len(code) - 1)
    other = np.flatnonzero(np.logical_or.reduceat(code[like] != code, starts) | (sizes != sizes[first[which]]))
    which[other] = len(first) + np.arange(len(other))
    first = np.append(first, other)
    return starts[first], sizes[first], which


def _with_bytes(model: PieceModel, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbols: characters that are no piece become the ids of their UTF-8 bytes."""
    odd = np.flatnonzero(symbols >= model.n_pieces)
    if not len(odd):
        return symbols.astype(np.int32), counts
    code = symbols[odd] - model.n_symbols
    listed = np.flatnonzero(code < 0)
    code[listed] = model.outside[symbols[odd[listed]] - model.n_pieces]
    raw = np.frombuffer(code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    size = np.ones(len(symbols), np.int64)
    size[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    out = np.repeat(symbols, size)
    before = np.cumsum(size) - size
    out[ranges(before[odd], size[odd])] = model.byte_id[raw]
    upto = np.append(0, np.cumsum(size))
    ends = np.cumsum(counts)
    return out.astype(np.int32), upto[ends] - upto[ends - counts]


# ---- decoding


def decode(model: PieceModel, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of lists of ids, one after another, counts[i] of them for text i. Bytes that are no UTF-8 become U+FFFD."""
    if len(ids) and (ids.min() < 0 or ids.max() >= model.n_pieces):
        raise ValueError("an id is outside the model")
    size = model.surface_size[ids]
    raw = model.surface[ranges(model.surface_start[ids], size)].tobytes()
    upto = np.append(0, np.cumsum(size))
    ends = np.cumsum(counts)
    starts = upto[ends - counts]
    if model.prefix:
        # The space that encoding put before the text goes again, if the first piece that shows anything begins with it.
        shown = np.flatnonzero(size)
        first = np.append(shown, len(ids))[np.searchsorted(shown, ends - counts)]
        has = first < ends
        has[has] = model.begins_with_space[ids[first[has]]]
        starts = starts + has
    return [raw[a:b].decode("utf-8", "trajectra-each-byte") for a, b in zip(starts.tolist(), upto[ends].tolist())]


# ---- on DataFrames


def texts_of(column: pa.Array) -> list[str | None]:
    """The texts of a column; bytes that are no UTF-8 become U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "trajectra-each-byte") for x in column.cast(pa.large_binary(), safe=False).to_pylist()]


def _added(df: DataFrame, column: str, out: str, kind: T.DataType, make) -> DataFrame:
    place = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, make(batch.column(place))], names=[*batch.schema.names, out])

    return map_arrow(df, run, T.StructType([*df.schema.fields, T.StructField(out, kind)]))


def encode_texts(df: DataFrame, model_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """df with out: the ids of column text_col, as the library's encode gives them without begin and end.

    A null or empty text has no ids. Rows that repeat are encoded each; an empty table gives an empty one. out must not be a column of
    df. model_path must be readable on every executor.
    """

    def make(column: pa.Array) -> pa.Array:
        ids, counts = encode(load(model_path), texts_of(column))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))

    return _added(df, text_col, out, T.ArrayType(T.IntegerType()), make)


def decode_ids(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with out: the text that the library's decode gives for the ids of column ids_col. Null or no ids give an empty text; an id
    outside the model raises ValueError. out must not be a column of df."""

    def make(column: pa.Array) -> pa.Array:
        counts = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
        return pa.array(decode(load(model_path), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts), pa.string())

    return _added(df, ids_col, out, T.StringType(), make)


def round_trip(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of every row: its text encoded, and the ids decoded again. Other columns aren't read."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = encode_texts(rows, model_path).select("id", "ids")
    back = decode_ids(ids, model_path)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return back.select(F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
