import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trajectra.llm.queries import op6_closed_syncmers
from trajectra.llm.syncmers import K, LONG, SLACK, fingerprint, with_anchors, with_likeness

from .helpers import DOCS, awkward, empty, prose

SPACE = " \t\n\x0b\x0c\r"


class Hashes:
    """Spark's hashes of strings and numbers, asked for in one go for each kind."""

    def __init__(self, spark, texts):
        self.units = {t: units(t) for t in texts}
        words = sorted({u for us in self.units.values() for u in us})
        self.word = self.ask(spark, [(w,) for w in words], "a string", F.xxhash64("a"))
        named = [[self.word[u,] for u in us] for us in self.units.values()]
        pairs = sorted({p for h in named for p in zip(h, h[1:])})
        self.pair = self.ask(spark, pairs, "a long, b long", F.xxhash64("a", "b"))
        runs = sorted({r for t in texts for r in self.runs(t)})
        self.run = self.ask(spark, runs, "a long, b long, c long", F.hash("a", "b", "c"))
        self.lone = self.ask(spark, sorted({(h,) for h in self.word.values()}), "a long", F.hash("a"))

    def ask(self, spark, rows, schema, how):
        return {tuple(r)[:-1]: r["h"] for r in spark.createDataFrame(rows, schema).withColumn("h", how).collect()} if rows else {}

    def inner(self, t):
        h = [self.word[u,] for u in self.units[t]]
        return [self.pair[p] for p in zip(h, h[1:])]

    def runs(self, t):
        s = self.inner(t)
        return [(s[i], s[i + 2], s[i + 3]) for i in range(len(s) - 3)]

    def anchors(self, t):
        """(place, anchor) by definition."""
        us = self.units[t]
        if len(us) < K:
            return [(i, self.lone[self.word[u,],]) for i, u in enumerate(us)]
        s = self.inner(t)
        all_ = [(i, self.run[r], min(s[i : i + 4]) in (s[i], s[i + 3])) for i, r in enumerate(self.runs(t))]
        return [(i, h) for i, h, closed in all_ if closed] or [(i, h) for i, h, _ in all_]


def units(text):
    words, word = [], ""
    for c in text + " ":
        if c in SPACE:
            words += [word] if 0 < len(word) <= LONG else list(word)
            word = ""
        else:
            word += c
    return words


def alike(a, b):
    if a == b:
        return 1.0
    a, b = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    met = [(i, b.index(x) - i) for i, x in enumerate(a) if x in b]
    place = [i + d for i, d in met]
    joins = lambda k, j: 0 <= j < len(met) and abs(met[j][1] - met[k][1]) <= SLACK and (place[j] < place[k]) == (j < k)
    ok = [joins(k, k - 1) or joins(k, k + 1) or len(met) == 1 and abs(d) <= SLACK for k, (_, d) in enumerate(met)]
    return sum(ok) / max(1, len(a) + len(b) - sum(ok))


def as_hex(anchors):
    return "".join(f"{x & 0xFFFFFFFF:08X}" for x in anchors)


def test_equal_texts_and_context_free_anchors(spark):
    passage = " ".join(f"p{i * i % 97}x{i}" for i in range(60))
    df = spark.createDataFrame([(1, passage), (2, passage), (3, "some words before " + passage + " and after"), (4, None), (5, "  "), (6, "few words")], "doc_id long, text string")
    out = {r["doc_id"]: r for r in fingerprint(df).collect()}
    assert out[1]["fingerprint"] == out[2]["fingerprint"] and len(out[1]["anchors"]) > 10
    assert out[1]["fingerprint"] in out[3]["fingerprint"]
    at = out[3]["anchors"].index(out[1]["anchors"][0])
    assert [p + 3 for p in out[1]["positions"]] == out[3]["positions"][at : at + len(out[1]["positions"])]
    assert out[4]["fingerprint"] == out[5]["fingerprint"] == "" and out[6]["positions"] == [0, 1]


def test_anchors_by_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(f"v{rng.randrange(31)}" for _ in range(n)) for n in (0, 1, 4, 5, 6, 7, 9, 80, 400)]
    texts += ["日本語の文章は空白なしで書かれるので一つの長い語になってしまうことがよくあります。" * 3, "a " * 50, "x" * 33 + " y", "\x0b odd\x1cspace 　 é ", " ".join(["w" * 32, "z" * 40] * 4)]
    known = Hashes(spark, texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprint(df).collect():
        want = known.anchors(texts[r["doc_id"]])
        assert list(zip(r["positions"], r["anchors"])) == want
        assert r["fingerprint"] == as_hex(h for _, h in want)
    assert [r["a"] for r in with_anchors(df, "text", "a").orderBy("doc_id").collect()] == [[h for _, h in known.anchors(t)] for t in texts]
    assert len(known.anchors(texts[9])) > 20


def test_likeness_by_brute_force(spark):
    rng = random.Random(2)
    base = [rng.randrange(-(1 << 31), 1 << 31) for _ in range(40)]
    pairs = [([1, 2, 3], [2, 3, 4]), ([], []), ([1], []), ([5, 5], [5]), ([7], [7]), ([1, 2, 7], [7]), ([7, 1], [2, 3, 4, 5, 6, 8, 9, 10, 7]), (base, base[10:] + base[:10]), (base, base[:15] + [1, 2, 3] + base[16:]), (base, base[::-1]), (base * 2, base), (base[:20] + base[:5], base[3:9] + [4])]
    for _ in range(60):
        a = [rng.randrange(30) for _ in range(rng.randrange(25))]
        pairs.append((a, [rng.randrange(30) if rng.random() < 0.3 else x for x in a[rng.randrange(5) :]]))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i long, a array<int>, b array<int>")
    got = [r["x"] for r in with_likeness(df, "a", "b", "x").orderBy("i").collect()]
    assert got == pytest.approx([alike(*p) for p in pairs])
    assert got[1] == got[4] == 1 and got[2] == got[6] == 0 and got[7] == 1 and got[9] < 0.1


def against_brute_force(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()]
    h = {r["text"]: r["h"] for r in spark.createDataFrame(sorted({(t,) for _, t in docs}), "text string").withColumn("h", F.xxhash64("text")).collect()} if docs else {}
    order = sorted(docs, key=lambda x: (x[0] is None, -(x[0] or 0), -h[x[1]]))
    edited = []
    for (i, text), (_, after) in zip(order, [*order[1:], *order[:1]]):
        half = len(text) // 2
        edited.append((i, text, text[: len(text) - half] + after[:half], after))
    known = Hashes(spark, sorted({x for _, *xs in edited for x in xs}))
    finger = lambda t: [x for _, x in known.anchors(t)]
    want = [(i, len(t), hashlib.sha256(e.encode()).hexdigest(), as_hex(finger(t)), as_hex(finger(e)), round(alike(finger(t), finger(e)), 9), round(alike(finger(t), finger(a)), 9)) for i, t, e, a in edited]
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in op6_closed_syncmers(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_query_on_awkward_rows(spark, tmp_path):
    """Null and repeated ids, repeated rows, columns with clashing names."""
    against_brute_force(spark, tmp_path, awkward(spark))


def test_query_over_ranges_and_far_ids(spark, tmp_path):
    rng = random.Random(6)
    ids = [*range(0, 900, 7), 10**12, -4, 1 << 40, 5, 5, None, None]
    against_brute_force(spark, tmp_path, spark.createDataFrame([(i, prose(rng, rng.randrange(30)), "en", "s", 0) for i in ids] + [(3, "same", None, None, None)] * 40, DOCS))


def test_an_only_row_follows_itself(spark, tmp_path):
    against_brute_force(spark, tmp_path, spark.createDataFrame([(5, "one two three four five six", "en", "s", 0)], DOCS))


def test_empty(spark, tmp_path):
    assert fingerprint(empty(spark)).count() == 0
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert op6_closed_syncmers(spark, str(tmp_path)).count() == 0
