import hashlib
import random
import zlib

import pytest

from trajectra.llm import manifest, ordering
from trajectra.llm.manifest import verified_manifest

from .helpers import DOCS, awkward, empty

NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def lower(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(leaves):
    """The root, and for each leaf its siblings level by level as (left, right)."""
    level, place, sides = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for leaf, at in enumerate(place):
            run, own = runs[at // 16], at % 16
            sides[leaf].append(("".join(run[:own]), "".join(run[own + 1 :])))
        place = [at // 16 for at in place]
        level = [h(*run) for run in runs]
    return level[0], sides


def brute(rows):
    of = {}
    for r in rows:
        leaf = h(*(field(r[c]) for c in NAMES))
        hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        claimed = h(*(field(lower(r[c]) if c == "text" and hit else r[c]) for c in NAMES))
        of.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf, claimed, r["doc_id"]))
    sources = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(of[s])]) for s in sources}
    root, tops = tree([trees[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops):
        for (_, _, leaf, claimed, i), sides in zip(sorted(of[s]), trees[s][1]):
            folded = claimed
            for left, right in sides + top:
                folded = h(left, folded, right)
            out.append((i, leaf, trees[s][0], root, h(*(x for side in sides + top for x in side)), folded, folded == root))
    return sorted(map(repr, out))


def check(df):
    got = verified_manifest(df)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(df.select(*NAMES).collect())


def test_awkward_rows(spark):
    check(awkward(spark))


@pytest.mark.parametrize("n", [1, 15, 16, 17])
def test_sizes_about_a_run(spark, n):
    check(spark.createDataFrame([(i, f"Text {i}", "en", "one", i) for i in range(n)], DOCS))


@pytest.mark.parametrize("most", [16_384, 3, 0])
def test_levels_and_many_sources(spark, monkeypatch, most):
    """Sources of one to 4,400 rows, more of them than a run has; nodes that are broadcast, and nodes that aren't."""
    monkeypatch.setattr(manifest, "MOST_BROADCAST", most)
    monkeypatch.setattr(ordering, "ROWS_PER_PART", 500)
    rng = random.Random(2)
    sizes = [4400, 257, 256, 1, 300, *[rng.randint(1, 20) for _ in range(30)]]
    rows = [(i * 3 % 4001, f"Row {i}", None if i % 5 else "de", None if k == 3 else f"söurce{k}" if k % 2 else f"S{k}", i) for k, n in enumerate(sizes) for i in range(n)]
    check(spark.createDataFrame(rows, DOCS))


def test_rows_that_are_equal(spark):
    check(spark.createDataFrame([(7, "Same", "en", "one", 4)] * 600 + [(None, "Same", "en", "one", 4)] * 40, DOCS))


def test_tampering_shows_exactly_where_letters_change(spark):
    rows = [(i, "UPPER" if i % 2 else "lower", "en", "one", 5) for i in range(200)]
    got = {r["doc_id"]: r["verified"] for r in verified_manifest(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows}


def test_empty(spark):
    got = verified_manifest(empty(spark))
    assert got.count() == 0 and "verified" in got.columns
