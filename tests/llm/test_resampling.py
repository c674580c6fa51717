import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trajectra.llm import resampling
from trajectra.llm.ordering import numbered
from trajectra.llm.resampling import advance, features, resample, word_places

from .helpers import awkward, empty, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, target, longest=1, buckets=10_000, seed=2024, least=20, percent=10):
    """rows of id and text; the rows of resample, told by repr."""

    def of(text):
        words = WORD.findall(lower(text))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    own, other = Counter(k for _, t in rows for k in of(t)[1]), Counter(k for t in target for k in of(t)[1])
    s, t = sum(own.values()), sum(other.values())
    gain = {k: math.floor(1000 * math.log((other[k] + 1) * (s + buckets) / ((own[k] + 1) * (t + buckets)))) for k in own}
    out = []
    for i, text in rows:
        n, keys = of(text)
        weight = sum(gain[k] for k in keys)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(keys), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = place + 1
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_against_brute_force(spark, longest):
    rng = random.Random(4)
    df = awkward(spark).unionByName(spark.createDataFrame([(100 + i, prose(rng, rng.randint(0, 60))) for i in range(300)], "doc_id long, text string"), allowMissingColumns=True)
    target = [prose(rng, 200), None, "", "ä 😀 z"]
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, percent=35)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], target, longest, percent=35)
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_words_of_sliced_columns_and_of_bytes():
    texts = ["ab", None, "C3po-über x", "", "y", "yz!", "\x00q", "z" * 500]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["zzz", *texts], kind)[1:]
        data, starts, sizes, words = word_places(column)
        assert [bytes(data[a : a + n]).decode() for a, n in zip(starts, sizes)] == [w for t in texts for w in WORD.findall(lower(t))]
        assert words.tolist() == [len(WORD.findall(lower(t))) for t in texts]
    bucket, row, words = features(pa.array([], pa.string()))
    assert len(bucket) == len(row) == len(words) == 0


@pytest.mark.parametrize("sizes", [[1], [63, 64, 65, 128, 129], [100_000, 1, 4096, 64 * 33 + 1]])
def test_registers_of_long_words(sizes):
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, sum(sizes), dtype=np.uint8)
    starts = np.cumsum(sizes) - sizes
    got = advance(data, np.full(len(sizes), 0xFFFFFFFF, np.uint32), starts, np.array(sizes)) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, sizes)]


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    """Many rows with one id, so one score, and equal ones."""
    rows = [(i % 7, " ".join(["w"] * 20)) for i in range(210)] + [(None, " ".join(["w"] * 20))] * 30
    got = resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("w",)], "text string"), percent=100).collect()
    ranked = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 241))
    keys = [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked]
    assert keys == sorted(keys)


def test_one_key_lies_in_many_ranges(spark, monkeypatch):
    """Places are dense within a key, though equal keys and equal orders are dealt to many tasks."""
    from trajectra.llm import ordering

    monkeypatch.setattr(ordering, "ROWS_PER_PART", 50)
    rows = spark.createDataFrame([(0 if i % 3 else i % 11, i % 2, i) for i in range(2000)], "key int, a int, mark int")
    out = numbered(rows, ["a", "mark"]).collect()
    want = {}
    for r in sorted(out, key=lambda r: (r["key"], r["a"], r["mark"])):
        want.setdefault(r["key"], []).append(r)
    for own in want.values():
        assert [r["idx"] for r in own] == list(range(len(own))) and {r["n"] for r in own} == {len(own)}
    parts = spark.read.parquet(numbered(rows, ["a", "mark"]).written_to).selectExpr("shiftright(at, 33) as p", "key").where("key = 0").distinct().count()
    assert parts > 10


def test_empty(spark):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resample(empty(spark), target).count() == 0
    rows = [(1, "a b c"), (2, None)]
    got = resample(spark.createDataFrame(rows, "doc_id long, text string"), target.limit(0), least_words=1, percent=100)
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(rows, [], least=1, percent=100)
