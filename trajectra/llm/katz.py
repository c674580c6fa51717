"""Katz back-off models: Good-Turing discounts, exactly normalised back-off weights, tables partitioned by order and bucket.

P(w | h) = d(c) c(h w) / c(h) for n-grams that training has, else a(h) P(w | h'), where h' is h without its first word;
P(w) = d(c) c(w) / N, scaled, for words of training, else what the discounts leave, for all unknown words together. a(h)
makes the sum over all words, the end and the unknown word exactly 1. Counts up to GT_MAX are discounted by Good-Turing's
estimate; greater ones lose as much as a count of GT_MAX does, so every history leaves something to the words that it hasn't had.

What moves are packed blocks of hashes. A block of documents asks for the counts of its different n-grams, by
order and range of the hash space (a bucket); a bucket adds up what training has, keeps it as its part of the
model's table and answers. The block then knows c(h w) and c(h) of every token, and evaluates the recursion down
to the longest n-gram that training has. Of its training rows it sends, for each history, how often each
count follows and the sum of P(w | h'); from these sums a bucket makes a(h), keeps it, and answers the
blocks that back off. Every step is a written table; nothing grows but the number of blocks and buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, new_path
from .items import add, batch_of, blocks, bucket_count, combine, distinct, hash_words, home, in_buckets, map_arrow, pack, pack_small, steps, unpack, unpack_small

#: Words of an n-gram.
ORDER = 2
#: Counts up to this are discounted by Good-Turing's estimate.
GT_MAX = 5
BOS, END = np.uint64(0x5BD1E995A7C31F03), np.uint64(0xC2B2AE3D27D4EB4F)
_SPEC = "kind int, bucket int, block long, payload binary"
_PACKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])
#: Kinds of rows: a block itself, what a block asks, what it is answered, a bucket's part of a table, counts of counts.
BLOCK, ASK, ANSWER, TABLE, STATS = range(5)
TOKENS, TYPES = -1, -2


# ---- blocks


def _make_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block: ids, which are null and which are training rows, words of each text, the block's words (hashes, most frequent first) and
    for each place its word's number, low bytes first, which leaves little to the higher bytes."""
    squeeze = zstd.ZstdCompressor(level=1)
    for block in blocks(batches):
        words, counts = hash_words(block.texts)
        names, at = distinct(words)
        turn = np.argsort(-np.bincount(at, minlength=len(names)), kind="stable")
        rank = np.empty(len(names), np.uint32)
        rank[turn] = np.arange(len(names))
        planes = rank[at].astype("<u4").view(np.uint8).reshape(-1, 4).T if len(at) else np.zeros((4, 0), np.uint8)
        ids = block.columns["id"]
        head = pack(np.array([i or 0 for i in ids], np.int64).view(np.uint64), np.array([i is None for i in ids], np.uint64), np.array(block.columns["train"], np.uint64), counts.astype(np.uint64))
        data = b"".join(len(p).to_bytes(8, "little") + p for p in (head, names[turn].astype("<u8").tobytes(), squeeze.compress(np.ascontiguousarray(planes).tobytes())))
        yield batch_of(_PACKED, [[BLOCK], [0], [block.key], [data]])


class Sequences:
    """The texts of a block as one sequence: for each a begin, its words, an end. names are the different hashes, sorted; at is each place's."""

    def __init__(self, data: bytes):
        parts, i = [], 0
        while i < len(data):
            n = int.from_bytes(data[i : i + 8], "little")
            parts.append(data[i + 8 : i + 8 + n])
            i += 8 + n
        ids, null, train, counts = unpack(parts[0])
        self.ids, self.null, self.trains, counts = ids.view(np.int64), null.astype(bool), train.astype(bool), counts.astype(np.int64)
        planes = np.frombuffer(zstd.ZstdDecompressor().decompress(parts[2]), np.uint8).reshape(4, -1).astype(np.int64)
        own = np.frombuffer(parts[1], "<u8")
        self.names, place = distinct(np.concatenate([own, np.array([BOS, END], np.uint64)]))
        ends = np.cumsum(counts + 2)
        self.begin = np.zeros(int(ends[-1]) if len(ends) else 0, bool)
        self.begin[ends - counts - 2] = True
        last = np.zeros(len(self.begin), bool)
        last[ends - 1] = True
        self.at = np.empty(len(self.begin), np.int64)
        self.at[self.begin], self.at[last] = place[-2], place[-1]
        self.at[~self.begin & ~last] = place[sum(x << 8 * i for i, x in enumerate(planes))]
        self.text = np.repeat(np.arange(len(counts)), counts + 2)
        self.train = self.trains[self.text]
        self._grams = {1: (self.names, self.at)}

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """The different keys of the n-grams that end at the places, sorted, and each place's. A text's begin is preceded by begins."""
        if order not in self._grams:
            names, at = self.grams(order - 1)
            keys = names[at]
            before = np.concatenate([keys[:1], keys[:-1]])
            before[self.begin] = keys[self.begin]
            self._grams[order] = distinct(combine(before, self.names[self.at]))
        return self._grams[order]


def begin_key(order: int) -> np.uint64:
    """The key of a text's begin, as an n-gram: it isn't a token, but how often it is a history."""
    key = np.array([BOS], np.uint64)
    for _ in range(order - 1):
        key = combine(key, np.array([BOS], np.uint64))
    return key[0]


# ---- counts


def _ask_counts(order: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("payload")):
                text = Sequences(data.as_py())
                names, at = text.grams(order)
                counts = np.bincount(at[text.train], minlength=len(names))
                out = [[], [], [], []]
                for b, some in in_buckets(names, n):
                    add(out, ASK, b, block, pack(steps(names[some]), *pack_small(counts[some])))
                yield batch_of(_PACKED, out)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "block", "payload")))


def _add_up(order: int, keep: bool):
    """Of one bucket: answers (the training counts of what each block asked, in its order) and, with keep, the bucket's table and counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, keys, counts = [], [], []
        here = 0
        for kind, here, block, data in _rows(batches):
            key, *more = unpack(data)
            keys.append(np.cumsum(key, dtype=np.uint64))
            counts.append(unpack_small(*more))
            asked.append((kind, block, len(key)))
        if not asked:
            return
        names, at = distinct(np.concatenate(keys))
        total = np.bincount(at, np.concatenate(counts).astype(float), len(names)).astype(np.int64)
        begin = 0
        for kind, block, n in asked:
            if kind == ASK:
                yield batch_of(_PACKED, [[ANSWER], [here], [block], [pack(*pack_small(total[at[begin : begin + n]]))]])
            begin += n
        if keep:
            seen = total > 0
            yield batch_of(_PACKED, [[TABLE], [here], [0], [pack(steps(names[seen]), *pack_small(total[seen]))]])
            tokens = total[seen & (names != begin_key(order))]
            r, times = np.unique(tokens[tokens <= GT_MAX + 1], return_counts=True)
            # Rows of (what, how many): tokens and types, then how many occur 1, 2, ... times.
            sums = [(TOKENS, tokens.sum()), (TYPES, len(tokens)), *zip(r, times)]
            yield batch_of(_PACKED, [[STATS] * len(sums), *([int(x) for x in c] for c in zip(*sums)), [None] * len(sums)])

    return run


def discounts(times: dict[int, int]) -> np.ndarray:
    """Factors for the counts 0 to GT_MAX by Katz's rule from how many things occur r times (0 has 0). Where the data give
    no factor between 0 and 1, half an occurrence is taken off."""
    n = [0] + [times.get(r, 0) for r in range(1, GT_MAX + 2)]
    share = (GT_MAX + 1) * n[GT_MAX + 1] / n[1] if n[1] else 1.0
    out = [0.0]
    for r in range(1, GT_MAX + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if n[r] and share < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return np.array(out)


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """What is left of counts: their factor's share, and above GT_MAX all but what a count of GT_MAX loses."""
    low = np.minimum(counts, GT_MAX)
    return np.where(counts <= GT_MAX, counts * factors[low], counts - GT_MAX * (1 - factors[GT_MAX]))


# ---- the model


@dataclass
class Rates:
    """The numbers of a model that every task needs: factors of each order, tokens and types of training, the unknown word's share, the scale of the others."""

    factors: list[np.ndarray]
    n_tokens: int
    n_types: int
    unknown: float
    scale: float

    def words(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, discounted(counts, self.factors[0]) * self.scale, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.n_tokens + 0.5 * (self.n_types + 1)))


@dataclass
class KatzModel:
    """counts: tables of n-gram counts (columns order, kind, bucket, payload), partitioned by order, a row a bucket; weights: those of back-off weights by history."""

    counts: DataFrame
    weights: DataFrame
    rates: Rates
    order: int
    buckets: int

    @property
    def n_tokens(self) -> int:
        return self.rates.n_tokens


def _rates(stats: DataFrame, order: int) -> Rates:
    """Of the rows of counts of counts, summed by order: a few numbers."""
    times: list[dict[int, int]] = [{} for _ in range(order)]
    for r in stats.groupBy("level", "bucket").agg(F.sum("block").alias("n")).collect():
        times[r["level"] - 1][r["bucket"]] = int(r["n"])
    total, types = times[0].get(TOKENS, 0), times[0].get(TYPES, 0)
    for t in times:
        t.pop(TOKENS, None), t.pop(TYPES, None)
    factors = [discounts(t) for t in times]
    lost = sum(n * r * (1 - factors[0][r]) for r, n in times[0].items() if r <= GT_MAX)
    lost += (types - sum(n for r, n in times[0].items() if r <= GT_MAX)) * GT_MAX * (1 - factors[0][GT_MAX])
    unknown = min(max(lost / max(total, 1), 1 / (total + 1)), 0.5) if total else 1.0
    return Rates(factors, total, types, unknown, (1 - unknown) / max(total - lost, 1e-300))


def _resolve(rates: Rates, order: int, n: int, learn: bool):
    """Of each block with its answered counts: how far its texts are scored (kind BLOCK: ids, tokens, known tokens, base
    score, score, and the texts and histories whose weights are still to be added), the histories that it
    asks for, and with learn what its training rows give to their histories' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, head, parts in _by_block(batches):
            text = Sequences(head)
            inner = ~text.begin
            token = np.flatnonzero(inner)
            m = len(text.ids)
            owner = text.text[token]
            out = [[], [], [], []]
            score = np.zeros(len(token))
            back: list[tuple] = []
            size = names = at = None
            for k in range(1, order + 1):
                before, (names, at) = (names, at), text.grams(k)
                counts = np.concatenate([unpack_small(*unpack(p)) for _, p in sorted(parts[k])])
                c = counts[at[token]]
                if k == 1:
                    base, known = rates.base(c), c > 0
                    p = rates.words(c)
                    score = np.log10(p)
                else:
                    history = before[1][token - 1]
                    size = sizes[history]
                    own = discounted(c, rates.factors[k - 1])
                    if learn:
                        some = text.train[token]
                        _contribute(out, k, n, before[0], block, history[some], c[some], p[some])
                    seen = c > 0
                    # What backs off goes on to the histories' weights; what is known here needs those of longer histories only.
                    gone = ~seen & (size > 0)
                    back = [(j, h, o, i) for j, h, o, i in ((j, h, o, i[~seen[i]]) for j, h, o, i in back) if len(i)]
                    back.append((k, before[0], history, np.flatnonzero(gone)))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        p = np.where(seen, own / size, np.nan)
                    score = np.where(seen, np.log10(np.where(seen, p, 1.0)), score)
                sizes = counts
            texts, asked, kinds, times = [], [], [], []
            for k, keys, history, i in back:
                pair, c = np.unique(owner[i] * len(keys) + history[i], return_counts=True)
                wanted, place = np.unique(pair % len(keys), return_inverse=True)
                texts.append(pair // len(keys)), asked.append(place + sum(kinds)), times.append(c), kinds.append(len(wanted))
                for b, some in in_buckets(keys[wanted], n):
                    add(out, ASK, b, block, pack(np.array([k], np.uint64), steps(keys[wanted][some])))
            sums = [np.bincount(owner, x, m).astype(float) for x in (np.ones(len(token)), known, base, score)]
            join = lambda x: np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.uint64)
            add(out, BLOCK, home(block, n), block, pack(text.ids.view(np.uint64), text.null.astype(np.uint64), *sums, np.array(kinds, np.uint64), join(texts), join(asked), join(times)))
            yield batch_of(_PACKED, out)

    return run


def _contribute(out: list[list], k: int, n: int, names: np.ndarray, block: int, history: np.ndarray, c: np.ndarray, p: np.ndarray) -> None:
    """To histories' sums: how often a count of 1, 2, ..., GT_MAX and above follows, and the shorter histories' probabilities of
    what follows, each different word once: a word that follows c times in all training counts 1 / c each time."""
    m = len(names)
    classes = np.bincount(history * (GT_MAX + 1) + np.minimum(c, GT_MAX + 1) - 1, minlength=m * (GT_MAX + 1)).reshape(m, GT_MAX + 1)
    # Words above GT_MAX lose a fixed part once each.
    above = np.bincount(history, (c > GT_MAX) / c, m)
    below = np.bincount(history, p / c, m)
    used = np.flatnonzero(classes.any(1))
    for b, some in in_buckets(names[used], n):
        i = used[some]
        # Few histories have words above GT_MAX; the others send nothing of them.
        add(out, ASK, b, block, pack(np.array([k], np.uint64), steps(names[i]), *[classes[i, r].astype(np.uint64) for r in range(GT_MAX + 1)], above[i][classes[i, GT_MAX] > 0], below[i]))


def _weigh(factors: list[np.ndarray], order: int, keep: bool):
    """Of one bucket: the weights of the histories that each block asked for, in its order, and with keep the bucket's table of weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, given, here = {}, {}, 0
        for kind, here, block, data in _rows(batches):
            if kind == BLOCK:
                yield batch_of(_PACKED, [[BLOCK], [here], [block], [data]])
                continue
            which, keys, *more = unpack(data)
            keys = np.cumsum(keys, dtype=np.uint64)
            if len(more) > 1:
                above = np.zeros(len(keys))
                above[more[GT_MAX] > 0] = more[GT_MAX + 1]
                more[GT_MAX + 1] = above
            if more:
                given.setdefault(int(which[0]), []).append((kind, keys, more))
            else:
                asked.setdefault(int(which[0]), []).append((block, keys))
        for k in range(2, order + 1):
            parts = given.get(k, [])
            if not parts:
                known, weight = np.zeros(0, np.uint64), np.zeros(0)
            elif parts[0][0] == TABLE:
                known, weight = (np.concatenate(x) for x in zip(*[(keys, more[0]) for _, keys, more in parts]))
                turn = np.argsort(known)
                known, weight = known[turn], weight[turn]
            else:
                known, at = distinct(np.concatenate([keys for _, keys, _ in parts]))
                sums = [np.bincount(at, np.concatenate([more[i] for *_, more in parts]).astype(float), len(known)) for i in range(GT_MAX + 3)]
                size = sum(sums[: GT_MAX + 1])
                lost = sum(sums[r - 1] * (1 - factors[k - 1][r]) for r in range(1, GT_MAX + 1)) + sums[GT_MAX + 1] * GT_MAX * (1 - factors[k - 1][GT_MAX])
                weight = lost / size / (1 - sums[GT_MAX + 2])
                if keep:
                    yield batch_of(_PACKED, [[TABLE], [here], [0], [pack(np.array([k], np.uint64), steps(known), weight)]])
            for block, keys in asked.get(k, []):
                at = np.searchsorted(known, keys)
                # A history that training has has a weight.
                yield batch_of(_PACKED, [[ANSWER], [here], [block], [pack(np.array([k], np.uint64), np.log10(weight[at]))]])

    return run


_OUT = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, dict[int, list]]]:
    """Each block of the partition with its answers, by order (or level): (bucket, payload)."""
    heads: dict[int, bytes] = {}
    parts: dict[int, dict[int, list]] = {}
    for batch in batches:
        for kind, bucket, block, level, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "block", "level", "payload"))):
            if kind == BLOCK:
                heads[block] = data
            else:
                parts.setdefault(block, {}).setdefault(level, []).append((bucket, data))
    for block in sorted(heads):
        yield block, heads.pop(block), parts.pop(block, {})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, head, parts in _by_block(batches):
        ids, null, n, known, base, score, kinds, texts, asked, times = unpack(head)
        # Answers come by level, then by bucket, as they were asked.
        got: dict[int, list] = {}
        for bucket, data in sorted(parts.get(0, [])):
            level, weights = unpack(data)
            got.setdefault(int(level[0]), []).append(weights)
        weights = np.concatenate([w for k in sorted(got) for w in got[k]] + [np.zeros(0)])
        assert len(weights) == kinds.sum()
        score = score + np.bincount(texts.astype(np.int64), weights[asked.astype(np.int64)] * times, len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64), mask=null.astype(bool)), *(pa.array(np.rint(x).astype(np.int64)) for x in (n, known)), pa.array(base), pa.array(score)], schema=_OUT)


def _run(df: DataFrame, order: int, model: KatzModel | None) -> tuple[KatzModel, DataFrame]:
    """df has id, text, train. Without a model it is made of the training rows. With it the scores of all rows."""
    n = max(model.buckets if model else 0, bucket_count(df, "text"))
    texts = materialise(map_arrow(df, _make_blocks, _SPEC), "blocks")
    at, counted = new_path(df.sparkSession, "katz"), None
    for k in range(1, order + 1):
        asks = map_arrow(texts, _ask_counts(k, n), _SPEC)
        if model:
            asks = asks.unionByName(_spread(model.counts.where(F.col("order") == k), n))
        one = materialise(map_arrow(asks.repartitionById(n, F.col("bucket")), _add_up(k, model is None), _SPEC), "counts", f"{at}/order={k}").withColumn("level", F.lit(k))
        counted = one if counted is None else counted.unionByName(one)
    rates = model.rates if model else _rates(counted.where(F.col("kind") == STATS), order)
    both = texts.withColumn("level", F.lit(0)).unionByName(counted.where(F.col("kind") == ANSWER))
    asks = histories = materialise(map_arrow(both.repartition(n, "block"), _resolve(rates, order, n, model is None), _SPEC), "histories")
    discard(texts)
    if model:
        asks = asks.unionByName(_spread(model.weights, n))
    weighed = materialise(map_arrow(asks.repartitionById(n, F.col("bucket")), _weigh(rates.factors, order, model is None), _SPEC), "weights")
    discard(histories)
    made = model or KatzModel(counted.where(F.col("kind") == TABLE).withColumnRenamed("level", "order"), weighed.where(F.col("kind") == TABLE), rates, order, n)
    left = weighed.where(F.col("kind") != TABLE).withColumn("level", F.lit(0))
    return made, map_arrow(left.repartition(n, "block"), _finish, "id long, n_tokens long, n_known long, base_score double, score double")


def _spread(table: DataFrame, n: int) -> DataFrame:
    """The rows of a table, cut to n buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, data in _rows(batches):
            first, *more = unpack(data)
            out = [[], [], [], []]
            if len(more) == 2 and more[1].dtype == np.float64:  # level, keys, weights
                keys = np.cumsum(more[0], dtype=np.uint64)
                for b, some in in_buckets(keys, n):
                    add(out, TABLE, b, 0, pack(first, steps(keys[some]), more[1][some]))
            else:
                keys, counts = np.cumsum(first, dtype=np.uint64), unpack_small(*more)
                for b, some in in_buckets(keys, n):
                    add(out, TABLE, b, 0, pack(steps(keys[some]), *pack_small(counts[some])))
            yield batch_of(_PACKED, out)

    return map_arrow(table.select("kind", "bucket", "block", "payload"), run, _SPEC)


def _input(df: DataFrame, id_col: str | None, text_col: str, train) -> DataFrame:
    return df.select((F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")).alias("id"), F.col(text_col).alias("text"), train.cast("int").alias("train"))


def fit_katz(texts: DataFrame, order: int = ORDER, text_col: str = "text") -> KatzModel:
    """A model of all rows; a null text is an empty one. Every n-gram up to order is kept, those that occur once too. Without
    rows, every token is unknown and has probability 1. Other columns are not read."""
    model, _ = _run(_input(texts, None, text_col, F.lit(1)), order, None)
    return model


def score_katz(model: KatzModel, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, base_score, score, train_tokens for every row of df.

    score is the log10 probability of the text's words and its end; base_score that of an additive unigram model.
    A null text is empty, one end; null and repeated ids are rows like others; an empty table gives none. Other columns are not read.
    """
    _, out = _run(_input(df, id_col, text_col, F.lit(0)), model.order, model)
    return out.withColumnRenamed("id", id_col).withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))


def fit_and_score(df: DataFrame, train, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> tuple[KatzModel, DataFrame]:
    """The model of the rows where the condition train holds (null: it doesn't) and the scores of all rows, as score_katz gives them:
    counts are answered where they are added up, so every text is read once."""
    model, out = _run(_input(df, id_col, text_col, F.coalesce(train, F.lit(False))), order, None)
    return model, out.withColumnRenamed("id", id_col).withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
