import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajectra.llm.items import bucket_of, bucket_start, by_bucket, combine, distinct, hash_words, home, in_buckets, pack, pack_small, steps, unpack, unpack_small
from trajectra.llm.katz import GT_MAX, TABLE, discounts, fit_and_score, fit_katz, score_katz
from trajectra.llm.queries import op4_katz_backoff

from .helpers import awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [*WORD.findall(lower(text)), "</s>"]


class Brute:
    """The model by its definition, on dictionaries."""

    def __init__(self, texts, order=2):
        self.order = order
        self.counts = {k: Counter(g[-k:] for t in texts for g in self.grams(t)) for k in range(1, order + 1)}
        self.factors = {k: discounts(Counter(c.values())) for k, c in self.counts.items()}
        words = self.words = {g[0]: c for g, c in self.counts[1].items()}
        self.total, self.types = sum(words.values()), len(words)
        kept = sum(self.cut(c, 1) for c in words.values())
        self.unknown = min(max((self.total - kept) / self.total, 1 / (self.total + 1)), 0.5) if words else 1.0
        self.scale = (1 - self.unknown) / kept if words else 0
        self.follow = {k: defaultdict(dict) for k in range(2, order + 1)}
        for k in range(2, order + 1):
            for g, c in self.counts[k].items():
                self.follow[k][g[:-1]][g[-1]] = c
        self.weights = {}
        for k in range(2, order + 1):
            for h, after in self.follow[k].items():
                left = 1 - sum(self.cut(c, k) for c in after.values()) / sum(after.values())
                self.weights[h] = left / (1 - sum(self.p(w, h[1:]) for w in after))

    def grams(self, text):
        ts = ["<s>"] * (self.order - 1) + tokens(text)
        return [tuple(ts[i : i + self.order]) for i in range(len(ts) - self.order + 1)]

    def cut(self, c, k):
        d = self.factors[k]
        return c * d[c] if c <= GT_MAX else c - GT_MAX * (1 - d[GT_MAX])

    def p(self, w, h):
        if not h:
            return self.cut(self.words[w], 1) * self.scale if w in self.words else self.unknown
        after = self.follow[len(h) + 1].get(h)
        if after and w in after:
            return self.cut(after[w], len(h) + 1) / sum(after.values())
        return (self.weights[h] if after else 1.0) * self.p(w, h[1:])

    def score(self, text):
        return sum(math.log10(self.p(g[-1], g[:-1])) for g in self.grams(text))

    def base(self, text):
        return sum(math.log10((self.words.get(w, 0) + 0.5) / (self.total + 0.5 * (self.types + 1))) for w in tokens(text))


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(150)]
    texts = []
    for _ in range(n):
        at, out = rng.randrange(150), []
        for _ in range(rng.randrange(0, 60)):
            at = (at * 7 + rng.choice([1, 1, 1, 2, 50])) % 150
            out.append(vocab[at].upper() if rng.random() < 0.1 else vocab[at])
        texts.append(" ".join(out))
    return texts + [" ".join(["very", "common"] * 300)] * 3


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_brute_force_and_sum_to_one(spark, order):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    brute = Brute([t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1], order)
    histories = [h for k in range(2, order + 1) for h in list(brute.follow[k])[:40]]
    for h in [*histories, ("<s>",) * (order - 1), ("never", "seen")[: order - 1]]:
        assert math.isclose(sum(brute.p(w, h) for w in brute.words) + brute.p(None, h), 1, rel_tol=1e-9)
    fitted = score_katz(fit_katz(df.where(train), order), df)
    model, together = fit_and_score(df, train, order)
    for rows in (fitted.collect(), together.collect()):
        assert len(rows) == len(texts)
        for r in rows:
            t = texts[r["doc_id"]]
            assert r["n_tokens"] == len(tokens(t)) and r["train_tokens"] == brute.total
            assert r["n_known"] == sum(w in brute.words for w in tokens(t))
            assert math.isclose(r["base_score"], brute.base(t), rel_tol=1e-9)
            assert math.isclose(r["score"], brute.score(t), rel_tol=1e-9), (t, r)
    # The tables have every n-gram, those that occur once too, and every history's weight.
    kept = Counter()
    for r in model.counts.where(F.col("kind") == TABLE).collect():
        kept[r["order"]] += len(unpack(bytes(r["payload"]))[0])
    begins = {k: k < order or k == 1 for k in kept}
    assert all(kept[k] in (len(brute.counts[k]), len(brute.counts[k]) + 1) for k in begins)
    assert sum(len(unpack(bytes(r["payload"]))[1]) for r in model.weights.collect()) == len(brute.weights)


def test_query_scores_held_out_and_training_rows(spark, tmp_path):
    texts = corpus(120, seed=3)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 1}
    brute = Brute([t for i, t in enumerate(texts) if i not in held])
    assert sum(c == 1 for c in brute.counts[2].values()) > 100
    rows = op4_katz_backoff(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts) and {r["doc_id"] for r in rows if r["held_out"]} == held
    assert all(math.isclose(r["score"], brute.score(texts[r["doc_id"]]), rel_tol=1e-9) for r in rows)


def test_many_blocks_and_more_buckets_than_the_model_has(spark, monkeypatch):
    from trajectra.llm import items

    monkeypatch.setattr(items, "BLOCK_BYTES", 500)
    df = spark.createDataFrame(list(enumerate(corpus(80))), "doc_id long, text string").repartition(5)
    brute = Brute(corpus(80))
    model = fit_katz(df)
    model.buckets = 1
    monkeypatch.setattr(items, "BUCKET_BYTES", 300)
    rows = score_katz(model, df).collect()
    assert len(rows) == 83 and all(math.isclose(r["score"], brute.score(corpus(80)[r["doc_id"]]), rel_tol=1e-9) for r in rows)


def test_awkward_rows(spark):
    """Null and repeated ids and texts, very long texts, clashing names: every row is a row of its own."""
    df = awkward(spark)
    brute = Brute([r["text"] for r in df.select("text").collect()])
    rows = score_katz(fit_katz(df), df).collect()
    want = sorted(round(brute.score(r["text"]), 6) for r in df.select("text").collect())
    assert sorted(round(r["score"], 6) for r in rows) == want
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.select("doc_id").collect())


def test_empty(spark):
    docs = empty(spark)
    assert score_katz(fit_katz(docs), docs).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = score_katz(fit_katz(docs), one).first()
    assert row["n_known"] == 0 and row["score"] == 0 and row["n_tokens"] == 3


@pytest.mark.parametrize("size", [3, 1 << 20])
def test_hash_words(monkeypatch, size):
    from trajectra.llm import items

    monkeypatch.setattr(items, "_STEP", size)
    rng = random.Random(0)
    texts = ["", " ", "A b\tc", "x" * 50, "  é Éa\x0b\x0cb ", *("".join(rng.choice("ab \n") for _ in range(rng.randrange(60))) for _ in range(40))]
    hashes, counts = hash_words([t.encode() for t in texts])
    words = [w for t in texts for w in WORD.findall(lower(t))]
    assert counts.tolist() == [len(WORD.findall(lower(t))) for t in texts] and len(hashes) == len(words)
    assert len(set(zip(words, hashes.tolist()))) == len(set(words)) == len(set(hashes.tolist()))


def test_pack():
    arrays = [np.array(x, np.uint64) for x in ([], [1, 255], [70000], [1 << 40, 5], [(1 << 64) - 1], [1 << 20], [1 << 50, 0], [1 << 47])] + [np.array([0.5, -2.0])]
    assert all((a == b).all() for a, b in zip(arrays, unpack(pack(*arrays))))
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    assert (np.cumsum(steps(keys), dtype=np.uint64) == keys).all()
    counts = np.array([0, 1, 254, 255, 256, 70_000, 3])
    assert (unpack_small(*pack_small(counts)) == counts).all()


@pytest.mark.parametrize("n", [1, 3, 64, 200, 2048, 65536, 70_000, 1 << 24])
def test_buckets(n):
    keys = np.sort(combine(np.arange(20_000, dtype=np.uint64)))
    names, at = distinct(np.concatenate([keys, keys[::3]]))
    assert (names == keys).all() and (names[at] == np.concatenate([keys, keys[::3]])).all()
    bucket = bucket_of(keys, n)
    assert bucket.min() >= 0 and bucket.max() < n and (np.diff(bucket) >= 0).all()
    rest = keys - bucket_start(bucket, n)
    assert (rest <= keys).all() and (rest + bucket_start(bucket, n) == keys).all()
    assert int(rest.max()) <= (1 << 64) // n + (1 << 48)
    assert [(b, x.tolist()) for b, x in by_bucket(bucket)] == [(b, list(range(s.start, s.stop))) for b, s in in_buckets(keys, n)]
    # Blocks are numbered in a row in each partition; their own rows go to all buckets alike.
    homes = Counter(home(part << 24 | i, n) for part in range(400) for i in range(10))
    assert max(homes.values()) <= 4000 / n + 6 * math.sqrt(4000 / n) + 6


def test_time_of_a_block_does_not_grow_with_the_buckets():
    import time

    keys = np.sort(combine(np.arange(200_000, dtype=np.uint64)))

    def took(n):
        began = time.perf_counter()
        assert sum(s.stop - s.start for _, s in in_buckets(keys, n)) == sum(len(x) for _, x in by_bucket(bucket_of(keys, n))) == len(keys)
        return time.perf_counter() - began

    took(64)
    few = min(took(20_000) for _ in range(3))
    assert min(took(2_000_000) for _ in range(3)) < 30 * few
