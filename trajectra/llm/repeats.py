"""Repeated passages by longest-previous-factor arrays, over a corpus that no single suffix array could hold.

A string of LENGTH bytes is told by where its smallest hashed K-mer lies (leftmost of equals): equal strings
have it at the same place, so they meet if strings are dealt out by it. Strings of a document that share this
anchor follow one another; together they are a stretch.

1. Anchors are counted by hash. A document keeps those that occur twice or more; others can't be in a repeat.
2. Documents with such anchors send the stretches around them to buckets of the hash space. A bucket joins its
   different stretches to one text, sorts its suffixes by their first LENGTH bytes, finds for each the previous
   and next smaller positions in that order, and so the array of longest previous factors and where they stand.
   Strings whose factor has LENGTH bytes, their first occurrences, and stretches that occur more than once repeat.
3. Around anchors that occur more than hot times (HOT), whose stretches would crowd one bucket, the hashes of the
   strings themselves are dealt out and counted instead, each once for each block of documents: the same result,
   by 64-bit hashes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .items import add, batch_of, blocks, bucket_count, bucket_of, by_bucket, home, map_arrow, mix, pack, runs, unpack

LENGTH, K = 200, 32
HOT = 1000
_SEGMENT = 1 << 20
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
_SPEC = "bucket int, kind int, block long, payload binary"
_MULT, _POS = 0x9FB21C651E98DF25, np.uint64((1 << 24) - 1)


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = _SEGMENT + LENGTH + 1
    up, down = np.full(n, _MULT, np.uint64), np.full(n, pow(_MULT, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _segments(text: bytes, length: int, hashes: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each segment: its place, then for each stretch its first string, number of strings and anchor; hashes of all strings, if asked for."""
    span = length - K + 1
    for place in range(0, max(1, len(text) - length + 1), _SEGMENT):
        b = np.frombuffer(text, np.uint8)[place : place + _SEGMENT + length - 1]
        if len(b) < length:
            return
        up, down = _powers()
        total = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_letters()[b] * up[: len(b)], out=total[1:])
        grams = mix((total[K:] - total[:-K]) * down[: len(b) - K + 1])
        low = (grams & ~_POS) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while 2 * step <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < span:
            low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
        at = (low & _POS).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.concatenate([first, [len(at)]]))
        strings = mix((total[length:] - total[:-length]) * down[: len(b) - length + 1]) if hashes else np.zeros(0, np.uint64)
        yield place, first, count, grams[at[first]], strings


# ---- 1. anchors


def _anchors(n: int, length: int):
    """Anchors are small hashes, being smallest ones, so they are mixed again before they are dealt to ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            got = [np.concatenate([a for _, _, _, a, _ in _segments(t, length, False)] or [np.zeros(0, np.uint64)]) for t in block.texts]
            doc = np.repeat(np.arange(len(got)), [len(g) for g in got])
            keys = np.concatenate(got) if got else np.zeros(0, np.uint64)
            order = np.lexsort((keys, doc))
            keys, doc = keys[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])])) if len(keys) else np.zeros(0, np.int64)
            c = np.diff(np.concatenate([new, [len(keys)]]))
            keys, doc = keys[new], doc[new]
            out = [[], [], [], []]
            ids = block.columns["id"]
            add(out, home(block.key, n), 0, block.key, pack(np.array([i or 0 for i in ids], np.int64).view(np.uint64), np.array([i is None for i in ids], np.uint64), np.array(block.columns["h"], np.int64).view(np.uint64)))
            for b, at in by_bucket(bucket_of(mix(keys), n)):
                which, times = runs(doc[at])
                add(out, b, 1, block.key, pack(which.astype(np.uint64), times.astype(np.uint64), keys[at], c[at].astype(np.uint64)))
            yield batch_of(_PACKED, out)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "block", "payload")))


def _count(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[tuple] = []
        for bucket, kind, block, data in _rows(batches):
            if kind == 0:
                yield batch_of(_PACKED, [[bucket], [0], [block], [data]])
            else:
                asked.append((block, *unpack(data)))
        if not asked:
            return
        keys, at = np.unique(np.concatenate([a[3] for a in asked]), return_inverse=True)
        total = np.bincount(at, np.concatenate([a[4] for a in asked]).astype(float))
        begin = 0
        for block, which, times, asks, _ in asked:
            n = total[at[begin : begin + len(asks)]]
            begin += len(asks)
            found = n > 1
            if found.any():
                names, some = runs(np.repeat(np.arange(len(which)), times.astype(np.int64))[found])
                yield batch_of(_PACKED, [[0], [1], [block], [pack(which[names], some.astype(np.uint64), asks[found], (n[found] > most).astype(np.uint64))]])

    return run


_KNOWN = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("known", pa.binary())])


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document that has any: its repeated anchors, sorted, and which are hot."""
    heads: dict[int, bytes] = {}
    parts: dict[int, list] = {}
    for _, kind, block, data in _rows(batches):
        if kind == 0:
            heads[block] = data
        else:
            parts.setdefault(block, []).append(unpack(data))
    for block, got in parts.items():
        ids, null, h = unpack(heads[block])
        doc = np.concatenate([np.repeat(w.astype(np.int64), t.astype(np.int64)) for w, t, _, _ in got])
        keys, hot = np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got])
        order = np.lexsort((keys, doc))
        doc, keys, hot = doc[order], keys[order], hot[order]
        names, times = runs(doc)
        ends = np.cumsum(times)
        yield batch_of(_KNOWN, [[None if null[d] else int(ids[d].view(np.int64)) for d in names], [int(h[d].view(np.int64)) for d in names], [pack(keys[b - t : b], hot[b - t : b]) for b, t in zip(ends, times)]])


# ---- 2. and 3. stretches


def _repeated(text: bytes, known: list[np.ndarray], length: int, want_hot: bool):
    """Of each segment: its place, first strings, counts, anchors of the stretches with repeated anchors that are, or aren't, hot."""
    keys, hot = known
    for place, first, count, anchor, strings in _segments(text, length, want_hot):
        at = np.minimum(np.searchsorted(keys, anchor), len(keys) - 1)
        ok = (keys[at] == anchor) & ((hot[at] > 0) == want_hot)
        yield place, first[ok], count[ok], anchor[ok], strings


def _hot_strings(text: bytes, known: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if known[1].any():
        for place, first, count, _, strings in _repeated(text, known, length, True):
            at = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(first) else np.zeros(0, np.int64)
            hashes.append(strings[at])
            places.append(at + place)
    return np.concatenate(hashes), np.concatenate(places)


def _result(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    """Bytes, bytes removed, runs removed, digest of the rest; spans may overlap."""
    kept, removed, n, at = hashlib.sha256(), 0, 0, 0
    end = -1
    for a, b in sorted(spans):
        if a > end:
            n += 1
            kept.update(text[at:a])
            removed += b - a
        elif b > end:
            removed += b - end
        end = max(end, b)
        at = end
    kept.update(text[at:])
    return len(text), removed, n, kept.hexdigest()


def _stretches(n: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstd.ZstdCompressor(level=1)
        for block in blocks(batches):
            out = [[], [], [], []]
            ids = np.array([i if i is not None else (1 << 63) - 1 for i in block.columns["id"]], np.int64)
            known = [unpack(k) if k else None for k in block.columns["known"]]
            shown = [(i, h, k is not None) for i, h, k in zip(block.columns["id"], block.columns["h"], known)]
            texts = [t for t, k in zip(block.texts, known) if k]
            done = [_result(t, []) for t, k in zip(block.texts, known) if not k]
            sizes = np.array([len(t) for t in texts], np.uint64)
            head = [np.array([i or 0 for i, _, _ in shown], np.int64).view(np.uint64), np.array([i is None for i, _, _ in shown], np.uint64), np.array([k for *_, k in shown], np.uint64), sizes, np.array([d[0] for d in done], np.uint64)]
            add(out, home(block.key, n), 0, block.key, _join(pack(*head), squeeze.compress(b"".join(texts)), "".join(d[3] for d in done).encode(), squeeze.compress(_join(*(k or b"" for k in block.columns["known"])))))
            rows: list[tuple] = []
            pieces: list[bytes] = []
            hot: list[tuple] = []
            for d, (text, k) in enumerate(zip(block.texts, known)):
                if not k:
                    continue
                for place, first, count, anchor, _ in _repeated(text, k, length, False):
                    rows.append((np.full(len(first), d), first + place, count, anchor))
                    pieces += [text[a : a + c + length - 1] for a, c in zip((first + place).tolist(), count.tolist())]
                hashes, places = _hot_strings(text, k, length)
                hot.append((hashes, np.full(len(hashes), ids[d]), places))
            if pieces:
                doc, first, count, anchor = (np.concatenate(x) for x in zip(*rows))
                for b, at in by_bucket(bucket_of(mix(anchor), n)):
                    which, times = runs(doc[at])
                    meta = pack(which.astype(np.uint64), times.astype(np.uint64), ids[which].view(np.uint64), first[at].astype(np.uint64), count[at].astype(np.uint64))
                    add(out, b, 1, block.key, _join(meta, squeeze.compress(b"".join(pieces[i] for i in at.tolist()))))
            if hot and sum(len(x) for x, _, _ in hot):
                hashes, owner, places = (np.concatenate(x) for x in zip(*hot))
                order = np.lexsort((places, owner, hashes))
                hashes, owner, places = hashes[order], owner[order], places[order]
                new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
                c = np.minimum(np.diff(np.concatenate([new, [len(hashes)]])), 2)
                hashes, owner, places = hashes[new], owner[new], places[new]
                for b, at in by_bucket(bucket_of(hashes, n)):
                    add(out, b, 2, block.key, pack(hashes[at], c[at].astype(np.uint64), owner[at].view(np.uint64), places[at].astype(np.uint64)))
            yield batch_of(_PACKED, out)

    return run


def _join(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _near_smaller(a: np.ndarray, step: int) -> np.ndarray:
    """For each place the nearest place before (step -1) or after (1) with a smaller value, or -1."""
    n = len(a)
    if step > 0:
        back = _near_smaller(a[::-1], -1)[::-1]
        return np.where(back >= 0, n - 1 - back, -1)
    out = np.arange(n) - 1
    todo = np.flatnonzero(out >= 0)
    while len(todo):
        todo = todo[(out[todo] >= 0)]
        todo = todo[a[out[todo]] > a[todo]]
        out[todo] = out[out[todo]]
    return out


def _refine(text: bytes, length: int, levels: list | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(depth, rank, shared): ranks of all suffixes by their first depth bytes, the largest 8 * 2^i up to length, equal for equal
    prefixes, and whether another suffix has the same. Depth doubles; only suffixes that are still shared are sorted again.
    levels, if given, gets the ranks of every depth."""
    b = np.frombuffer(text + b"\0" * 8, np.uint8)
    n = len(text)
    words = np.zeros(n, np.uint64)
    for i in range(8):
        words <<= np.uint64(8)
        words |= b[i : n + i]
    open_ = np.argsort(words).astype(np.int32)  # a bucket's text is well below 2^31 bytes
    key, base = words[open_], np.zeros(n, np.int32)
    del words
    rank, depth = np.zeros(n, np.int32), 8
    while True:
        first, begin = np.ones(len(key), bool), np.ones(len(key), bool)
        first[1:], begin[1:] = key[1:] != key[:-1], base[1:] != base[:-1]
        del key
        at = np.arange(len(open_), dtype=np.int32)
        base -= np.maximum.accumulate(np.where(begin, at, np.int32(0)))
        base += np.maximum.accumulate(np.where(first, at, np.int32(0)))
        del at, begin
        rank[open_] = base
        if levels is not None:
            levels.append((depth, rank.astype(np.int64)))
        lone = first.copy()
        lone[:-1] &= first[1:]
        open_ = open_[~lone]
        del first, lone, base
        if 2 * depth > length:
            break
        after = open_ + depth
        after = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[open_].astype(np.uint64) << np.uint64(32) | after.astype(np.uint64)
        del after
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        del order
        base = rank[open_]
        depth *= 2
    shared = np.zeros(n, bool)
    shared[open_] = True
    return depth, rank, shared


def previous_factors(text: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending places starts, at length bytes at least from the end: its longest previous factor, cut to length and 0
    where it is shorter, and the earlier place (as an index of starts) where that stands, or -1.

    In suffix order, equal up to length, the previous and next smaller places of a suffix share the longest prefixes with it
    of all earlier places. As factor_lengths, but suffixes that share length bytes with neither neighbour in that order, which
    can't reach it, are left out of the search."""
    depth, rank, shared = _refine(text, length)
    some = np.flatnonzero(shared[starts] & shared[starts + (length - depth)])
    del shared
    key = rank[starts[some]].astype(np.int64) << 32 | rank[starts[some] + (length - depth)]
    del rank
    order = np.argsort(key, kind="stable")
    key = key[order]
    like = key[1:] == key[:-1]
    kept = np.concatenate([[False], like]) | np.concatenate([like, [False]]) if len(key) else np.zeros(0, bool)
    order, key = some[order[kept]], key[kept]
    lengths, source = np.zeros(len(starts), np.uint16), np.full(len(starts), -1, np.int32)
    for step in (-1, 1):
        other = _near_smaller(starts[order], step)
        reaches = (other >= 0) & (key[other] == key)
        lengths[order[reaches]], source[order[reaches]] = length, order[other[reaches]]
    return lengths, source


def repeated(lengths: np.ndarray, source: np.ndarray, length: int, keep: str) -> np.ndarray:
    """Which strings go, by the array of longest previous factors: those that have an earlier one; unless the first is kept, it goes too. It
    is the source of the second, whose smaller places in suffix order are the first's."""
    hit = lengths >= length
    if keep != "first":
        hit[source[np.flatnonzero(hit)]] = True
    return hit


def factor_lengths(text: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending places starts, at length bytes at least from the end: the length of the longest
    factor that begins there and also begins at an earlier place of starts, and at a later one; at most length.

    Suffixes are ordered by their first length bytes; in that order the previous and next smaller place of a
    suffix share the longest prefixes with it of all earlier places (with greater places: of all later ones)."""
    ranks: list[tuple[int, np.ndarray]] = []
    depth, rank, _ = _refine(text, length, ranks)
    b, n = np.frombuffer(text, np.uint8), len(text)
    order = np.argsort(rank[starts].astype(np.int64) << 32 | rank[starts + length - depth], kind="stable")
    place = starts[order]

    def common(other: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(other >= 0)
        x, y = place[some], place[other[some]]
        got = np.zeros(len(some), np.int64)
        for step, r in [*reversed(ranks), *[(1, b)] * 7]:
            for _ in range(2 if step > 1 else 1):
                same = (got + step <= length) & (r[np.minimum(x + got, n - 1)] == r[np.minimum(y + got, n - 1)])
                got[same] += step
        out = np.zeros(len(place), np.int64)
        out[some] = got
        return out

    def longest(values: np.ndarray) -> np.ndarray:
        found = np.maximum(common(_near_smaller(values, -1)), common(_near_smaller(values, 1)))
        out = np.empty(len(starts), np.int64)
        out[order] = found
        return out

    return longest(place), longest(-place)


def _factors(length: int, keep: str):
    """Of one bucket: the spans of each block's documents that its stretches find repeated (kind 1), and repeated hot strings (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch: dict[bytes, int] = {}
        owner: list[tuple[int, int]] = []
        times: list[int] = []
        asked, hot = [], []
        open_ = zstd.ZstdDecompressor()
        for bucket, kind, block, data in _rows(batches):
            if kind == 0:
                yield batch_of(_PACKED, [[bucket], [0], [block], [data]])
            elif kind == 2:
                hot.append((block, unpack(data)))
            else:
                meta, raw = _split(data)
                which, some, ids, first, count = unpack(meta)
                raw, at, named = open_.decompress(raw), 0, []
                ids = np.repeat(ids.astype(np.uint64).view(np.int64), some.astype(np.int64))
                for i, j, c in zip(ids.tolist(), first.tolist(), count.tolist()):
                    piece = raw[at : at + c + length - 1]
                    at += c + length - 1
                    s = stretch.setdefault(piece, len(owner))
                    if s == len(owner):
                        owner.append((i, j))
                        times.append(0)
                    times[s] += 1
                    owner[s] = min(owner[s], (i, j))
                    named.append(s)
                asked.append((block, which, some, ids, first, count, named))
        if asked:
            # Stretches stand in the order of their first occurrence, so earlier places are earlier occurrences.
            turn = sorted(range(len(owner)), key=owner.__getitem__)
            pieces = list(stretch)
            text = b"".join(pieces[s] for s in turn)
            size = np.array([len(pieces[s]) for s in turn])
            begin = np.cumsum(size) - size
            number = size - length + 1
            starts = np.repeat((begin - (np.cumsum(number) - number)).astype(np.int32), number)
            starts += np.arange(len(starts), dtype=np.int32)
            hit = repeated(*previous_factors(text, starts, length), length, keep)
            edge = np.cumsum(number) - number
            found = {}
            for r, s in enumerate(turn):
                found[s] = hit[edge[r] : edge[r] + number[r]]
            del text, starts
            for block, which, some, ids, first, count, named in asked:
                doc, a, b = [], [], []
                for d, i, j, c, s in zip(np.repeat(which, some.astype(np.int64)).tolist(), ids.tolist(), first.tolist(), count.tolist(), named):
                    if times[s] > 1 and (keep != "first" or owner[s] != (i, j)):
                        doc.append(d), a.append(j), b.append(j + c - 1 + length)
                        continue
                    flag = found[s]
                    if flag.any():
                        cut = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
                        for x, y in zip(cut[::2].tolist(), cut[1::2].tolist()):
                            doc.append(d), a.append(j + x), b.append(j + y - 1 + length)
                if doc:
                    yield batch_of(_PACKED, [[0], [1], [block], [pack(*(np.array(x, np.uint64) for x in (doc, a, b)))]])
        if hot:
            keys = np.concatenate([x[0] for _, x in hot])
            ids = np.concatenate([x[2] for _, x in hot]).astype(np.uint64).view(np.int64)
            places = np.concatenate([x[3] for _, x in hot]).astype(np.int64)
            order = np.lexsort((places, ids, keys))
            keys, first = np.unique(keys[order], return_index=True)
            total = np.bincount(np.searchsorted(keys, np.concatenate([x[0] for _, x in hot])), np.concatenate([x[1] for _, x in hot]).astype(float), len(keys))
            ids, places = ids[order][first], places[order][first]
            for block, (asks, *_) in hot:
                at = np.searchsorted(keys, asks)
                at = at[total[at] > 1]
                if len(at):
                    yield batch_of(_PACKED, [[0], [2], [block], [pack(keys[at], ids[at].view(np.uint64), places[at].astype(np.uint64))]])

    return run


_OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def _remove(length: int, keep: str, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, bytes] = {}
        parts: dict[int, list] = {}
        for _, kind, block, data in _rows(batches):
            if kind == 0:
                heads[block] = data
            else:
                parts.setdefault(block, []).append((kind, data))
        open_ = zstd.ZstdDecompressor()
        for block, data in heads.items():
            meta, raw, digests, known = _split(data)
            ids, null, has, sizes, lengths = unpack(meta)
            raw, known = open_.decompress(raw), [k for k in _split(open_.decompress(known)) if k]
            spans: dict[int, list] = {}
            strings = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for kind, got in parts.pop(block, ()):
                if kind == 1:
                    for d, a, b in zip(*(x.tolist() for x in unpack(got))):
                        spans.setdefault(d, []).append((a, b))
                else:
                    key, owner, place = unpack(got)
                    for to, x in zip(strings, (key, owner.astype(np.uint64).view(np.int64), place.astype(np.int64))):
                        to.append(x)
            key, owner, place = (np.concatenate(x) for x in strings)
            order = np.argsort(key)
            key, owner, place = key[order], owner[order], place[order]
            out = [[] for _ in _OUT]
            at = other = turn = 0
            for d in range(len(ids)):
                i = None if null[d] else int(ids[d].view(np.int64))
                if not has[d]:
                    add(out, i, int(lengths[other]), 0, 0, digests[64 * other : 64 * other + 64].decode(), None)
                    other += 1
                    continue
                text = raw[at : at + int(sizes[turn])]
                at += len(text)
                mine = spans.get(d, [])
                if len(key):
                    hashes, places = _hot_strings(text, unpack(known[turn]), length)
                    x = np.minimum(np.searchsorted(key, hashes), len(key) - 1)
                    ok = key[x] == hashes
                    if keep == "first":
                        ok &= (owner[x] != (i if i is not None else (1 << 63) - 1)) | (place[x] != places)
                    mine = mine + [(p, p + length) for p in places[ok].tolist()]
                turn += 1
                cut = _result(text, mine)
                add(out, i, *cut, _rest(text, mine) if texts else None)
            yield batch_of(_OUT, out)

    return run


def _rest(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    gone = np.zeros(len(text) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b] -= 1
    return np.frombuffer(text, np.uint8)[np.cumsum(gone[:-1]) == 0].tobytes()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep: str = "none", texts: bool = False, hot: int = HOT) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256 for every row of df; with texts=True also kept, the rest of
    its bytes where any were removed.

    Bytes of the UTF-8 text go that lie in a string of length bytes which begins at another place too, in the same
    row or another. With keep="first" the first of equal strings, by id and place, stays. A null text is
    empty; null ids come last and are rows like others, as are repeated ids; an empty table gives none. Other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    n = bucket_count(rows, "text")
    asked = map_arrow(rows, _anchors(n, length), _SPEC).repartitionById(n, F.col("bucket"))
    known = map_arrow(map_arrow(asked, _count(hot), _SPEC).repartition(n, "block"), _known, "id long, h long, known binary")
    known = materialise(known.groupBy("id", "h").agg(F.first("known").alias("known")), "anchors")
    known = known.select(F.col("id").alias("k_id"), F.col("h").alias("k_h"), "known")
    joined = rows.join(known, rows["id"].eqNullSafe(known["k_id"]) & (rows["h"] == known["k_h"]), "left").select("id", "h", "known", "text")
    # Blocks are numbered by the order of rows, which is made the same for every attempt of a task.
    sent = map_arrow(joined.sortWithinPartitions("id", "h"), _stretches(n, length), _SPEC).repartitionById(n, F.col("bucket"))
    answers = map_arrow(sent, _factors(length, keep), _SPEC).repartition(n, "block")
    out = map_arrow(answers, _remove(length, keep, texts), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col) if texts else out.drop("kept").withColumnRenamed("id", id_col)
