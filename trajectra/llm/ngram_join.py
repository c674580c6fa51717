"""Similarity join of documents by the Jaccard likeness of their word n-gram sets.

1. Every document becomes a set of hashed n-grams. Equal sets are one class from here on.
2. The n-grams, packed by hash bucket, meet to be counted; those of one set only are dropped there, the others
   go back to their sets with their counts. A set orders what came back rarest first, after the n-grams that no
   other set has.
3. A set is indexed under those of its first n - ceil(t n) + 1 n-grams that another set has: two sets that reach
   the threshold t share one of them. Two sets under one n-gram are compared on what the index holds: sizes (length
   filter), the n-gram's places (positional filter), and how many n-grams of the suffix after it lie in each of CELLS parts of the
   hash space, and whether evenly many in each of ODD finer parts (suffix filter: the parts' differences bound the suffixes'
   distance from below).
4. Pairs that pass are verified on the whole sets, each once. At first each set is paired, under each n-gram, with the n-gram's
   least set and with a few neighbours in the order of their smallest hash, which most near copies share; what this
   links is merged. Then, in turns, each set with one of another component under each n-gram, while that links anything: what has
   links to a large component needs one of them. Then all pairs that pass, of classes that aren't linked yet and that weren't verified before. N-grams
   under which everything is linked are left out; under the others the sets of the largest class meet only the rest, in tiles of
   bounded size. A group in which everything is linked costs as many pairs as it has sets, not their square. Tiles are made once: components only
   grow, so what a later turn has to compare lies in them, and a turn takes on only those rows that passed with one of another component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, discard, materialise, shuffle_parts
from .items import add, batch_of, blocks, bucket_count, bucket_of, bucket_start, by_bucket, combine, hash_words, home, map_arrow, mix, pack, runs, unpack

#: Words of an n-gram; a pair links if PERCENT * |union| <= 100 * |intersection|.
N, PERCENT = 5, 80
#: Sets of one side of a tile of a frequent n-gram, and rows of one partition of the index.
TILE, INDEX_ROWS = 512, 60_000
#: Parts of the hash space in the suffix filter, counted and told odd from even.
CELLS, ODD = 64, 512
#: Neighbours that a set is first paired with, and sets of a chunk in which they are sought.
NEAR, CHUNK = 3, 128
#: Turns at most in which sets are paired with one set of another component under each n-gram, before all that is left is.
ROUNDS = 4
#: Pairs of whole sets, and sets, that a worker gets at once: a long document's takes as much room as its text; rows of the index that it gives at once.
VERIFIED, SETS, INDEXED = 24, 64, 8192
_PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
_SETS = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("h", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64()), ("lone", pa.int64()), ("items", pa.binary())])


def shingle_sets(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The different hashed n-grams of each text, one text after another, sorted, and the text each belongs to.
    A text with fewer words has one, all its words; a text without words none."""
    words, counts = hash_words(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    if len(words) >= n:
        whole = doc[: len(words) - n + 1] == doc[n - 1 :]
        grams = combine(*(words[i : len(words) - n + 1 + i] for i in range(n)))[whole]
        where = doc[: len(words) - n + 1][whole]
    else:
        grams, where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    starts = np.cumsum(counts) - counts
    few = [combine(*(words[starts[d] + i : starts[d] + i + 1] for i in range(counts[d])), np.full(1, counts[d], np.uint64))[0] for d in short]
    grams, where = np.concatenate([grams, np.array(few, np.uint64)]), np.concatenate([where, short])
    order = np.lexsort((grams, where))
    grams, where = grams[order], where[order]
    if len(grams):
        new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (where[1:] != where[:-1])])
        grams, where = grams[new], where[new]
    return grams, where


def _digests(grams: np.ndarray, where: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set. Sums of mixed members: equal sets have equal ones in any order."""
    starts = np.searchsorted(where, np.arange(m))
    out = []
    for salt in (0x51ED270B7D3D7C9B, 0xA0761D6478BD642F):
        total = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix(grams ^ np.uint64(salt)), out=total[1:])
        ends = np.concatenate([starts[1:], [len(grams)]]) if m else starts
        out.append(mix(total[ends] - total[starts] + (ends - starts).astype(np.uint64)))
    return out[0], out[1]


def _ask(n_buckets: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            grams, where = shingle_sets(block.texts, n)
            m = len(block.texts)
            size = np.bincount(where, minlength=m)
            hi, lo = _digests(grams, where, m)
            ids = block.columns["id"]
            null = np.array([i is None for i in ids], np.uint64)
            ids = np.array([i or 0 for i in ids], np.int64).view(np.uint64)
            out = [[], [], [], []]
            add(out, home(block.key, n_buckets), 0, block.key, pack(ids, null, size.astype(np.uint64), hi, lo, np.array(block.columns["h"], np.int64).view(np.uint64)))
            # Of equal sets in the block the first asks for all.
            _, first = np.unique(np.stack([hi, lo], 1), axis=0, return_index=True)
            asks = np.zeros(m, bool)
            asks[first] = True
            grams, where = grams[asks[where]], where[asks[where]]
            for b, at in by_bucket(bucket_of(grams, n_buckets)):
                which, times = runs(where[at])
                add(out, b, 1, block.key, pack(which.astype(np.uint64), times.astype(np.uint64), grams[at] - bucket_start(b, n_buckets)))
            yield batch_of(_PACKED, out)

    return run


def _count(n: int):
    """Of one bucket: for each block the items that occur in two sets or more, and in how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        here = 0
        for batch in batches:
            for bucket, kind, block, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "block", "payload"))):
                if kind == 0:
                    yield batch_of(_PACKED, [[bucket], [0], [block], [data]])
                else:
                    here = bucket
                    asked.append((block, *unpack(data)))
        if not asked:
            return
        keys, df = runs(np.sort(np.concatenate([a[3] for a in asked])))
        keys, df = keys[df > 1], df[df > 1]
        if not len(keys):
            return
        for block, which, times, asks in asked:
            at = np.minimum(np.searchsorted(keys, asks), len(keys) - 1)
            found = keys[at] == asks
            if found.any():
                doc = np.repeat(np.arange(len(which)), times.astype(np.int64))[found]
                names, times = runs(doc)
                full = asks[found] + bucket_start(here, n)
                yield batch_of(_PACKED, [[0], [1], [block], [pack(which[names], times.astype(np.uint64), full, df[at[found]].astype(np.uint64))]])

    return run


def least_partner(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest size that a set linked to one of size n has; also the least overlap with any."""
    return -(-n * percent // 100)


def least_overlap(a, b, percent: int):
    return -(-(a + b) * percent // (100 + percent))


def _order(percent: int):
    """Rows of kind 0: the documents with their sets. Rows of kind 1: the sets that can have a partner, items rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, bytes] = {}
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for kind, block, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "payload"))):
                if kind == 0:
                    heads[block] = data
                else:
                    parts.setdefault(block, []).append(data)
        for block, data in heads.items():
            ids, null, size, hi, lo, h = unpack(data)
            m, size = len(ids), size.astype(np.int64)
            out = pa.array(ids.view(np.int64), mask=null.astype(bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), out, pa.array(h.view(np.int64)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(size), pa.array(np.zeros(m, np.int64)), pa.nulls(m, pa.binary())], schema=_SETS)
            got = [unpack(x) for x in parts.pop(block, ())]
            if not got:
                continue
            doc = np.concatenate([np.repeat(w.astype(np.int64), t.astype(np.int64)) for w, t, _, _ in got])
            item, df = np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got])
            order = np.lexsort((item, df, doc))
            doc, item = doc[order], item[order]
            names, shared = runs(doc)
            ends = np.cumsum(shared)
            rows = [[] for _ in _SETS]
            able = shared >= least_partner(size[names], percent)
            for d, a, b in zip(names[able].tolist(), (ends - shared)[able].tolist(), ends[able].tolist()):
                add(rows, 1, None, None, int(hi[d].view(np.int64)), int(lo[d].view(np.int64)), int(size[d]), int(size[d]) - (b - a), item[a:b].tobytes())
            if rows[0]:
                yield batch_of(_SETS, rows)

    return run


_INDEX = pa.schema([("item", pa.int64()), ("sid", pa.int64()), ("n", pa.int64()), ("lone", pa.int64()), ("pos", pa.int64()), ("sign", pa.int64()), ("suffix", pa.binary())])


def _index(percent: int):
    """A row for each set and each item of its prefix that another set has. sign is the set's smallest hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in _INDEX]
            for sid, n, lone, data in zip(*(batch.column(c).to_pylist() for c in ("sid", "n", "lone", "items"))):
                items = np.frombuffer(data, np.uint64)
                k = min(n - int(least_partner(np.array(n), percent)) + 1 - lone, len(items))
                if k <= 0:
                    continue
                mixed = mix(items)
                fine = (mixed >> np.uint64(48)).astype(np.int64) % ODD
                cell = fine % CELLS
                # From the last of the prefix back, each row's suffix has one more than the next one's.
                counts, odd = np.bincount(cell[k:], minlength=CELLS), np.bincount(fine[k:], minlength=ODD) & 1 > 0
                left: list[bytes] = []
                for i in range(k - 1, -1, -1):
                    # 255 stands for more, which makes differences smaller, never larger.
                    left.append(np.minimum(counts, 255).astype(np.uint8).tobytes() + np.packbits(odd).tobytes())
                    counts[cell[i]] += 1
                    odd[fine[i]] ^= True
                out[0] += items[:k].view(np.int64).tolist()
                for column, value in zip((1, 2, 3, 5), (sid, n, lone, int(mixed.min().view(np.int64)))):
                    out[column] += [value] * k
                out[4] += range(lone, lone + k)
                out[6] += left[::-1]
                if len(out[0]) >= INDEXED:
                    yield batch_of(_INDEX, out)
                    out = [[] for _ in _INDEX]
            if out[0]:
                yield batch_of(_INDEX, out)

    return run


def passes(percent: int, a: tuple, b: tuple) -> np.ndarray:
    """Whether pairs of index rows (n, lone, pos, suffix) under one item can reach the threshold: by length, by the item's places, by suffix."""
    return slack(percent, a, b) >= 0


def slack(percent: int, a: tuple, b: tuple) -> np.ndarray:
    """How far the bound of a pair's overlap is above what the threshold needs; below 0, -1."""
    (na, la, pa_, sa), (nb, lb, pb, sb) = a, b
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    need = least_overlap(na, nb, percent)
    before = np.minimum(pa_ - la, pb - lb) + 1  # what other sets haven't got comes first and matches nothing
    ra, rb = na - pa_ - 1, nb - pb - 1
    ok = (100 * small >= percent * large) & (before + np.minimum(ra, rb) >= need)
    at = np.flatnonzero(ok)
    counted = np.abs(sa[at, :CELLS].astype(np.int16) - sb[at, :CELLS].astype(np.int16)).sum(1, dtype=np.int64)
    far = np.maximum(counted, np.bitwise_count(sa[at, CELLS:] ^ sb[at, CELLS:]).sum(1, dtype=np.int64))
    out = np.full(len(ok), -1, np.int64)
    out[at] = np.maximum(before[at] + (ra[at] + rb[at] - far) // 2 - need[at], -1)
    return out


def _suffixes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS + ODD // 8)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pair_rows(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs, the smaller first, without those of a set with itself."""
    both = np.stack([np.minimum(x, y), np.maximum(x, y)], 1)
    both = both[both[:, 0] != both[:, 1]]
    for k in range(0, len(both), 100_000):
        yield batch_of(_PAIRS, [both[k : k + 100_000, 0], both[k : k + 100_000, 1]])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that come sorted by keys, in tables of INDEX_ROWS or a little more that end where a group ends."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= INDEX_ROWS:
            whole = pa.Table.from_batches(held)
            last = np.ones(rows, bool)
            for k in keys:
                column = whole.column(k).to_numpy()
                last &= column == column[-1]
            cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
            if cut:
                yield whole.slice(0, cut)
                held, rows = whole.slice(cut).combine_chunks().to_batches(), rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy() for c in names]


def _near_pairs(percent: int):
    """Of sorted chunks of n-grams: pairs of each row with its n-gram's least set, and with the NEAR rows after it, that pass the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, ["item", "chunk"]):
            item, chunk, sid, n, lone, pos = _columns(t, "item", "chunk", "sid", "n", "lone", "pos")
            suffix = _suffixes(t.column("suffix"))
            new = np.concatenate([[True], (item[1:] != item[:-1]) | (chunk[1:] != chunk[:-1])])
            group = np.cumsum(new) - 1
            # The n-gram's least set is the least of each of its chunks: the others got a copy of its row.
            hub = np.lexsort((sid, group))[np.flatnonzero(new)][group]
            ok = passes(percent, (n, lone, pos, suffix), (n[hub], lone[hub], pos[hub], suffix[hub]))
            found = [(sid[ok], sid[hub[ok]])]
            for d in range(1, NEAR + 1):
                a = np.flatnonzero((item[d:] == item[:-d]) & (chunk[d:] == chunk[:-d]))
                b = a + d
                ok = passes(percent, *((n[x], lone[x], pos[x], suffix[x]) for x in (a, b)))
                found.append((sid[a[ok]], sid[b[ok]]))
            yield from _pair_rows(*(np.concatenate(x) for x in zip(*found)))

    return run


def _across(t: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of sorted tiles: places of pairs of rows of different components that pass the filters, and their slack; on a tile of two sides,
    those between the sides. No place comes twice on one side of what is given at once."""
    item, tile, side, n, lone, pos, comp = _columns(t, "item", "tile", "side", "n", "lone", "pos", "comp")
    suffix = _suffixes(t.column("suffix"))
    group = np.cumsum(np.concatenate([[True], (item[1:] != item[:-1]) | (tile[1:] != tile[:-1])])) - 1
    count = np.bincount(group)
    left = np.repeat(np.cumsum(count), count) - np.arange(len(group)) - 1  # rows of the group that come after
    at, d = np.flatnonzero(left > 0), 1
    while len(at):
        a, b = at, at + d
        ok = (comp[a] != comp[b]) & ((side[a] == -1) | (side[a] != side[b]))
        a, b = a[ok], b[ok]
        over = slack(percent, *((n[x], lone[x], pos[x], suffix[x]) for x in (a, b)))
        ok = over >= 0
        yield a[ok], b[ok], over[ok]
        d += 1
        at = at[left[at] >= d]


#: The columns of a tile, and what a turn gives: pairs (a, b), and the rows that passed with one of another component (no a, b).
_TILE = ("item", "tile", "side", "sid", "n", "lone", "pos", "suffix")
_TURN = pa.schema([("a", pa.int64()), ("b", pa.int64()), *((c, pa.binary() if c == "suffix" else pa.int64()) for c in _TILE)])


def _best_pairs(percent: int, turn: int):
    """Of sorted tiles: each row with one row of another component, as many pairs as rows at most. The one of most slack, in later turns one by hash.
    Also the rows that have such a one: the others pass with no row of another component in their tile, and components only grow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, ["item", "tile"]):
            sid = t.column("sid").to_numpy()
            best, partner = np.full(len(sid), -1, np.int64), np.arange(len(sid))
            for a, b, over in _across(t, percent):
                if turn:
                    both = sid.view(np.uint64)
                    over = (mix(both[a] + both[b] + np.uint64(turn)) >> np.uint64(1)).astype(np.int64)
                for x, y in ((a, b), (b, a)):
                    more = over > best[x]
                    best[x[more]], partner[x[more]] = over[more], y[more]
            pairs = np.unique(np.sort(np.stack([sid, sid[partner]], 1), axis=1), axis=0)
            for found in _pair_rows(pairs[:, 0], pairs[:, 1]):
                none = [pa.nulls(found.num_rows, f.type) for f in list(_TURN)[2:]]
                yield pa.RecordBatch.from_arrays([found.column("a"), found.column("b"), *none], schema=_TURN)
            alive = t.select(_TILE).filter(pa.array(best >= 0)).combine_chunks()
            for kept in alive.to_batches(max_chunksize=INDEXED):
                none = pa.nulls(kept.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, *kept.columns], schema=_TURN)

    return run


def _all_pairs(percent: int):
    """Of sorted tiles: all pairs of rows of different components that pass the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, ["item", "tile"]):
            sid = t.column("sid").to_numpy()
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b, _ in _across(t, percent):
                held.append((sid[a], sid[b]))
                if sum(len(x) for x, _ in held) > 1 << 18:
                    yield from _pair_rows(*(np.concatenate(x) for x in zip(*held)))
                    held = []
            if held:
                yield from _pair_rows(*(np.concatenate(x) for x in zip(*held)))

    return run


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], []]
            for a, b, na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "na", "nb", "xa", "xb"))):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                if both * (100 + percent) >= percent * (na + nb):
                    add(out, a, b)
            if out[0]:
                yield batch_of(schema, out)

    return run


def components(links: DataFrame) -> DataFrame:
    """node, label for the nodes of links (a, b): label is the smallest node that links lead to.

    Every node goes to the least of its neighbours and itself, and on from there until it stays where it is. What links then lead from
    one of these nodes to another make the next, smaller graph, until there are none. Every step is written, so a lost executor costs the step at most.
    """
    a, b = F.col("a"), F.col("b")
    edges = materialise(links.where("a <> b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    # A node that is linked with itself only is a component, too.
    alone = links.where("a = b").select(a.alias("node"), a.alias("label"))
    labels = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(b.alias("a"), a.alias("b"))).select(a.alias("node"), F.least(a, b).alias("label"))
        both = both if labels is not None else both.unionByName(alone)
        up = materialise(both.groupBy("node").agg(F.min("label").alias("label")), "up")
        while True:
            above = up.select(F.col("node").alias("label"), F.col("label").alias("top"))
            new = materialise(up.join(above, "label").select("node", F.col("label").alias("old"), F.col("top").alias("label")), "up")
            up = new.select("node", "label")
            if new.where("label <> old").isEmpty():
                break
        end = lambda c: up.select(F.col("node").alias(c), F.col("label").alias(f"{c}_to"))
        moved = edges.join(end("a"), "a").join(end("b"), "b").where("a_to <> b_to")
        edges = materialise(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        labels = up if labels is None else _relabelled(labels, up)
        if edges.isEmpty():
            return labels


def _relabelled(labels: DataFrame, up: DataFrame) -> DataFrame:
    """labels (node, label) with the labels of labels that up (node, label) has."""
    renamed = up.select(F.col("node").alias("label"), F.col("label").alias("top"))
    return materialise(labels.join(renamed, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels of components, as components gives them, after more links (a, b): only what these join is gone through."""
    if links.isEmpty():
        return labels
    end = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_to"))
    named = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
    up = components(named)
    fresh = up.join(labels, "node", "left_anti")
    return _relabelled(labels, up).unionByName(fresh)


def _candidates_near(index: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs under each n-gram that are likely to be linked: as many as the index has rows, a few times over."""
    # A power of two, so that n-grams of about the same sets have the same chunks, and so the same neighbours.
    chunks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("sets") / CHUNK, F.lit(1.0))))).cast("long")
    rows = index.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("sid"), "chunks"))
    hubs = rows.where((F.col("chunks") > 1) & (F.col("sid") == F.col("least")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda c: c != F.col("chunk"))
    columns = ("item", "chunk", "sid", "n", "lone", "pos", "suffix", "sign")
    rows = rows.select(*columns).unionByName(hubs.withColumn("chunk", F.explode(others)).select(*columns))
    rows = rows.repartition(parts, "item", "chunk").sortWithinPartitions("item", "chunk", "sign", "sid").drop("sign")
    return map_arrow(rows, _near_pairs(percent), "a long, b long").distinct()


def _tiles(index: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of n-grams that several components have, in tiles of bounded size in which all rows of different components meet."""
    names = labels.select(F.col("node").alias("sid"), F.col("label").alias("comp"))
    named = lambda rows: rows.join(names, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    by = named(index.select("item", "sid")).groupBy("item", "comp").agg(F.count(F.lit(1)).alias("c"))
    by = by.groupBy("item").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    # The largest component's rows only meet the others'.
    by = by.select("item", F.col("most.comp").alias("major"), F.ceil((F.col("all") - F.col("most.c")) / TILE).alias("minors"), F.ceil(F.col("most.c") / TILE).alias("majors"), F.col("all").alias("rows"))
    rows = index.select("item", "sid", "n", "lone", "pos", "suffix")
    placed = named(attach(rows, materialise(by, "several"), ["item"], "rows", rows.count()).where("major is not null"))
    own, more = F.col("comp") == F.col("major"), lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    turn = F.pmod(F.xxhash64("sid"), F.when(own, F.col("majors")).otherwise(F.col("minors")))
    placed = placed.withColumn("turn", turn)
    k, m, t = F.col("minors"), F.col("majors"), F.col("turn")
    # Tiles 0 to k * k - 1 are of two minor chunks, those after of a minor and a major one.
    square = F.transform(more(k), lambda j: F.struct((F.least(t, j) * k + F.greatest(t, j)).alias("tile"), F.when(j == t, F.lit(-1).cast("long")).otherwise(t).alias("side")))
    across = F.transform(more(m), lambda j: F.struct((k * k + t * m + j).alias("tile"), F.lit(-2).cast("long").alias("side")))
    other = F.transform(more(k), lambda j: F.struct((k * k + j * m + t).alias("tile"), F.lit(-3).cast("long").alias("side")))
    tiled = placed.withColumn("to", F.explode(F.when(own, other).otherwise(F.concat(square, across))))
    return materialise(tiled.select("item", "to.tile", "to.side", "sid", "n", "lone", "pos", "suffix", "comp"), "tiles")


def _met(tiled: DataFrame, by, schema: str = "a long, b long") -> DataFrame:
    """What by makes of tiles."""
    parts = max(shuffle_parts(tiled.sparkSession), -(-tiled.count() // INDEX_ROWS))
    return map_arrow(tiled.repartition(parts, "item", "tile").sortWithinPartitions("item", "tile", "lone", "sid"), by, schema)


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As merged_classes, with its links in place of the components that they make."""
    documents, classes, links, _ = merged_classes(df, id_col, text_col, n, percent)
    return documents, classes, links


def merged_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links, labels): documents has id, h (hash of the text), n, hi, lo (the class of its n-gram set); classes has hi, lo,
    least (smallest id), members, sid (null: no other class can be linked); links has a, b (sid of two classes), enough of them to connect
    whatever the threshold connects; labels are their components. Documents without n-grams are in no class."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    buckets = bucket_count(rows, "text")
    schema = "bucket int, kind int, block long, payload binary"
    asked = map_arrow(rows, _ask(buckets, n), schema).repartitionById(buckets, F.col("bucket"))
    asked = map_arrow(asked, _count(buckets), schema)
    both = map_arrow(asked.repartition(buckets, "block"), _order(percent), "kind int, id long, h long, hi long, lo long, n long, lone long, items binary")
    both = materialise(both, "sets")
    documents = both.where("kind = 0").select("id", "h", "n", "hi", "lo")
    sets = both.where("kind = 1").groupBy("hi", "lo").agg(F.first("n").alias("n"), F.first("lone").alias("lone"), F.first("items").alias("items"))
    # Numbered when written, so what reads them finds the same numbers.
    sets = materialise(sets.withColumn("sid", F.monotonically_increasing_id()), "classes")
    classes = documents.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("members"))
    classes = classes.join(sets.select("hi", "lo", "sid"), ["hi", "lo"], "left")
    index = materialise(map_arrow(sets.select("sid", "n", "lone", "items"), _index(percent), "item long, sid long, n long, lone long, pos long, sign long, suffix binary"), "index", records=SETS)
    total = index.count()
    sizes = materialise(index.groupBy("item").agg(F.count(F.lit(1)).alias("sets"), F.min("sid").alias("least")).where("sets > 1"), "sizes")
    shared = materialise(attach(index, sizes, ["item"], "sets", total).where("sets is not null"), "shared")
    discard(index)
    parts = max(shuffle_parts(df.sparkSession), -(-total // INDEX_ROWS))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        # Only the sets that a pair has are moved.
        asked = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))
        some = materialise(sets.select("sid", "n", "items").join(asked, "sid", "left_semi"), "asked", records=SETS)
        side = lambda s: some.select(F.col("sid").alias(s), F.col("n").alias(f"n{s}"), F.col("items").alias(f"x{s}"))
        out = materialise(map_arrow(pairs.join(side("a"), "a").join(side("b"), "b"), _verify(percent), "a long, b long"), name, records=VERIFIED)
        discard(some)
        return out

    seen = materialise(_candidates_near(shared, percent, parts), "near")
    links = verified(seen, "links")
    labels = components(links)
    tiled = _tiles(shared, labels)
    for turn in range(ROUNDS):
        found = materialise(_met(tiled, _best_pairs(percent, turn), "a long, b long, item long, tile long, side long, sid long, n long, lone long, pos long, suffix binary"), "turn")
        best = materialise(found.where("a is not null").select("a", "b").distinct().join(seen, ["a", "b"], "left_anti"), "near")
        seen, new = seen.unionByName(best), verified(best, "links")
        links, labels = links.unionByName(new), merged(labels, new)
        names = labels.select(F.col("node").alias("sid"), F.col("label").alias("comp"))
        alive = found.where("a is null").select(*_TILE).join(names, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
        discard(tiled)
        tiled = materialise(alive, "tiles")
        discard(found)
        if new.isEmpty():
            break
    later = materialise(_met(tiled, _all_pairs(percent)).distinct().join(seen, ["a", "b"], "left_anti"), "near")
    later = verified(later, "links")
    return documents, classes, links.unionByName(later), merged(labels, later)


def _components_of(df: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> DataFrame:
    """id, h (hash of the text), n_shingles, component_id, and which (hi, lo of a class of the component: its name, as ids may repeat) of every row."""
    documents, classes, _, groups = merged_classes(df, id_col, text_col, n, percent)
    members = classes.join(groups.select(F.col("node").alias("sid"), "label"), "sid")
    least = members.groupBy("label").agg(F.min("least").alias("component"), F.min(F.struct("hi", "lo")).alias("which"))
    named = groups.join(least, "label").select(F.col("node").alias("sid"), "component", "which")
    classes = classes.join(named, "sid", "left")
    linked = F.col("which").isNotNull()
    component = F.when(linked, F.col("component")).otherwise(F.col("least"))
    classes = classes.select("hi", "lo", "members", component.alias("component"), F.when(linked, F.col("which")).otherwise(F.struct("hi", "lo")).alias("which"))
    out = attach(documents, materialise(classes, "components"), ["hi", "lo"], "members", documents.count())
    return out.select("id", "h", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"), "which")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """id_col, n_shingles, component_id for every row of df.

    component_id is the smallest id that links lead to, the row's own included. Rows without words or with a null
    text have no n-grams and link with nothing. Null ids link like others and are never a component's id unless
    it has no other. Rows that repeat an id are rows of their own. An empty table gives none. Other columns are not read.
    """
    return _components_of(df, id_col, text_col, n, percent).select(F.col("id").alias(id_col), "n_shingles", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """The rows of df, with their columns, one of each component: of the rows with its smallest id the one with the smallest hash of
    its text, and of rows that are equal in both any one; null ids come last. Rows without words are in no component and all
    stay. An empty table gives none."""
    found = materialise(_components_of(df, id_col, text_col, n, percent).where("n_shingles > 0"), "members")
    first = found.groupBy("which").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "h")).alias("first"))
    times = found.groupBy("id", "h").agg(F.count(F.lit(1)).alias("times"))
    one = first.select(F.col("first.id").alias("kept_id"), F.col("first.h").alias("kept_h"))
    one = materialise(one.join(times, F.col("kept_id").eqNullSafe(F.col("id")) & (F.col("kept_h") == F.col("h"))).select("kept_id", "kept_h", "times"), "kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), (~text.rlike("[^ \\t-\\r]")).alias("blank"))
    kept = rows.where("not blank").join(one, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("h") == F.col("kept_h")))
    again = kept.where("times > 1").groupBy("id", "h").agg(F.first("row").alias("row"))
    return rows.where("blank").select("row.*").unionByName(kept.where("times = 1").select("row.*")).unionByName(again.select("row.*"))
