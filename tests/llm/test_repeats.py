import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from trajectra.llm import repeats
from trajectra.llm.repeats import factor_lengths, previous_factors, remove_repeats, repeated

from .helpers import awkward, empty, prose


def brute(rows, length, keep):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[j : j + length] for _, t in texts for j in range(len(t) - length + 1))
    first = {}
    for i, t in sorted(texts, key=lambda r: (r[0] is None, r[0] or 0)):
        for j in range(len(t) - length + 1):
            first.setdefault(t[j : j + length], (i, j))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - length + 1):
            s = t[j : j + length]
            if seen[s] > 1 and (keep == "none" or first[s] != (i, j)):
                gone[j : j + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        rest = bytes(b for b, g in zip(t, gone) if not g)
        out.append((i, len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    passages = [prose(rng, rng.choice([30, 45, 60, 200])) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(0, 80))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            cut = rng.randrange(0, len(p) // 2) if rng.random() < 0.5 else 0
            parts += [p[cut:], prose(rng, rng.randrange(0, 30))]
        rows.append((i, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, "ab" * 400), (102, "x" * 199), (103, "x" * 200), (104, "x" * 201), (105, "é" * 150), (106, rows[5][1][7:])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("hot", [1000, 3])
def test_against_brute_force(spark, keep, hot):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in remove_repeats(df, keep=keep, hot=hot).collect()), key=repr)
    assert got == brute(rows, 200, keep)


@pytest.mark.parametrize("hot", [100_000, 1000])
def test_a_passage_that_occurs_often(spark, hot):
    """More than a thousand times, in texts that differ around it, through suffix arrays and by counted hashes."""
    rng = random.Random(7)
    passage = prose(rng, 70)
    rows = [(i, f"{i * 7919 % 10_007} {passage[: rng.randrange(250, len(passage))]} {i}") for i in range(1300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in remove_repeats(df, hot=hot).collect()), key=repr)
    assert got == brute(rows, 200, "none")


def test_long_texts_go_in_segments(monkeypatch):
    monkeypatch.setattr(repeats, "_SEGMENT", 500)
    repeats._powers.cache_clear()
    text = prose(random.Random(1), 1000).encode()
    parts = [(place + f, c, a) for place, first, count, anchor, _ in repeats._segments(text, 200, False) for f, c, a in zip(first, count, anchor)]
    assert sum(c for _, c, _ in parts) == len(text) - 199
    monkeypatch.undo()
    repeats._powers.cache_clear()
    whole = {int(f): int(a) for _, first, _, anchor, _ in repeats._segments(text, 200, False) for f, a in zip(first, anchor)}
    at = None
    for f, _, a in parts:
        at = whole.get(int(f), at)
        assert at == a


def test_factor_lengths():
    rng = random.Random(2)
    for _ in range(20):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(40, 120)))
        length = rng.choice([8, 11, 20, 37])
        starts = np.arange(len(text) - length + 1)
        before, after = factor_lengths(text, starts, length)

        def longest(i, others):
            best = 0
            for j in others:
                k = 0
                while k < length and text[i + k] == text[j + k]:
                    k += 1
                best = max(best, k)
            return best

        assert before.tolist() == [longest(i, range(i)) for i in starts]
        assert after.tolist() == [longest(i, range(i + 1, len(starts))) for i in starts]
        lengths, source = previous_factors(text, starts, length)
        assert lengths.tolist() == [length if x >= length else 0 for x in before]
        assert all((s < 0) == (x < length) and (s < 0 or s < i and text[s : s + length] == text[i : i + length]) for i, (x, s) in enumerate(zip(before, source)))
        assert repeated(lengths, source, length, "first").tolist() == (before >= length).tolist()
        assert repeated(lengths, source, length, "none").tolist() == ((before >= length) | (after >= length)).tolist()


def test_awkward_rows(spark):
    df = awkward(spark)
    got = sorted((tuple(r) for r in remove_repeats(df).collect()), key=repr)
    assert got == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], 200, "none")


def test_kept_bytes(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in remove_repeats(df, texts=True).collect():
        if r["n_removed"]:
            assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"]


def test_empty(spark):
    assert remove_repeats(empty(spark)).count() == 0
