import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from trajectra.llm import ngram_join
from trajectra.llm.ngram_join import components, drop_near_duplicates, near_duplicates

from .helpers import awkward, empty, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text, n=5):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(key)
    out = []
    for i, (key, _) in enumerate(rows):
        known = [k for k in groups[root(i)] if k is not None]
        out.append((key, len(sets[i]), (min(known) if known else None) if sets[i] else key))
    return sorted(out, key=repr)


def run(df):
    return sorted((tuple(r) for r in near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


def variants(rng, base, k, changes):
    out = []
    for _ in range(k):
        words = base.split()
        for _ in range(changes(rng)):
            at = rng.randrange(len(words))
            kind = rng.random()
            if kind < 0.6:
                words[at] = f"z{rng.randrange(10**6)}"
            elif kind < 0.8:
                words.insert(at, f"y{rng.randrange(50)}")
            elif len(words) > 1:
                del words[at]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("tile", [1024, 6])
def test_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    rng = random.Random(11)
    texts = []
    shared = prose(rng, 60)
    for _ in range(12):
        base = prose(rng, rng.choice([3, 6, 15, 40, 120, 300]))
        texts += variants(rng, base, 8, lambda r: r.choice([0, 0, 1, 1, 2, 3, 5]))
    base = prose(rng, 150)
    texts += variants(rng, base, 60, lambda r: r.choice([1, 2, 3, 4])) + [base]
    texts += [prose(rng, 20) + " " + shared + " " + prose(rng, 30) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts, 100))
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words[:13])), (2, " ".join(words[1:14])), (3, " ".join(words[20:33])), (4, " ".join(words[20:32] + ["q"])), (5, "a b"), (6, "A  B"), (7, "a b c")]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_awkward_rows(spark):
    df = awkward(spark)
    assert run(df) == brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])


def test_one_document_of_each_group_stays(spark):
    df = awkward(spark)
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    left = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    groups = {c for i, n, c in brute(rows) if n}
    assert sorted(c for i, t in left for c in [i] if grams(t)) == sorted(groups)
    assert sorted(map(repr, [x for x in left if not grams(x[1])])) == sorted(map(repr, [x for x in rows if not grams(x[1])]))


def test_one_row_stays_of_ids_that_repeat(spark):
    rng = random.Random(3)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a, "x"), (1, a + " tail", "y"), (1, b, "z"), (2, b, "u"), (3, a, "v"), (1, a, "w"), (None, c, "p"), (None, c, "q"), (4, None, "r"), (4, None, "s")]
    left = drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, extra string")).collect()
    assert sorted(repr(r["doc_id"]) for r in left) == ["1", "1", "4", "4", "None"]
    assert {b} < {r["text"] for r in left} and c in {r["text"] for r in left} and len({a, a + " tail"} & {r["text"] for r in left}) == 1


def test_filters_keep_every_pair_that_reaches_the_threshold():
    """Of sets and a global order, the index rows of each n-gram that both have in their prefixes."""
    import numpy as np

    rng = np.random.default_rng(2)
    kept = refused = 0
    for _ in range(300):
        n = int(rng.integers(5, 400))
        base = rng.choice(1 << 62, n, replace=False)
        other = base.copy()
        other[rng.random(n) < rng.choice([0.02, 0.08, 0.1, 0.12, 0.3])] += 1
        if rng.random() < 0.5:
            other = other[: int(n * rng.choice([0.8, 0.9, 1]))]
        df = Counter(base.tolist()) + Counter(other.tolist())
        rows = []
        for x in (base, other):
            order = sorted(x.tolist(), key=lambda i: (df[i], i))
            lone = sum(df[i] == 1 for i in order)
            batch = pa.RecordBatch.from_pydict({"sid": [0], "n": [len(order)], "lone": [lone], "items": [np.array(order[lone:], np.uint64).tobytes()]})
            rows.append({r["item"]: r for b in ngram_join._index(80)(iter([batch])) for r in b.to_pylist()})
        both = len(set(base.tolist()) & set(other.tolist()))
        true = 100 * both >= 80 * (len(base) + len(other) - both)
        side = lambda r: (*(np.array([r[c]]) for c in ("n", "lone", "pos")), np.frombuffer(r["suffix"], np.uint8)[None])
        met = [bool(ngram_join.passes(80, side(rows[0][i]), side(rows[1][i]))[0]) for i in rows[0].keys() & rows[1].keys()]
        if true:
            assert met and all(met)
            kept += 1
        refused += met.count(False)
    assert kept > 50 and refused > 50


def test_no_pair_is_verified_twice(spark, monkeypatch):
    rng = random.Random(9)
    texts = [t for _ in range(6) for t in variants(rng, prose(rng, 60), 12, lambda r: r.choice([0, 1, 2, 3, 6]))]
    rows = list(enumerate(texts))
    # Every pair that reaches the verification, from both rounds.
    monkeypatch.setattr(ngram_join, "_verify", lambda percent: _passing)
    _, _, links = ngram_join.similar_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    seen = Counter(tuple(r) for r in links.collect())
    assert len(seen) > 20 and max(seen.values()) == 1 and all(a < b for a, b in seen)


def _passing(batches):
    for b in batches:
        yield b.select(["a", "b"])


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 520)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(45)]
    want = {}
    for a, b in links:
        want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(200):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()} == want


def test_empty(spark):
    assert near_duplicates(empty(spark)).count() == 0 and drop_near_duplicates(empty(spark)).count() == 0


def test_a_large_group_makes_no_square_of_pairs(spark, monkeypatch):
    """500 texts of one group: those of one change are linked with each other and with those of two, which hardly are among themselves.
    What the last step makes, all pairs of what isn't merged, stays below the rows that go in."""
    rng = random.Random(11)
    base = prose(rng, 150)
    rows = [(i, t) for i, t in enumerate(variants(rng, base, 500, lambda r: 1 if r.random() < 0.2 else 2))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made, plain = {}, ngram_join.map_arrow

    def counted(rows, f, schema):
        out = plain(rows, f, schema)
        if "_all_pairs" in f.__qualname__:
            made["rows in"], made["rows out"] = rows.count(), out.count()
        return out

    monkeypatch.setattr(ngram_join, "map_arrow", counted)
    assert run(df) == brute(rows)
    assert made["rows out"] <= made["rows in"], made


def test_later_turns_get_only_rows_that_passed(spark, monkeypatch):
    """40 texts share a passage and are otherwise strangers: no two pass, so after the first turn their rows are gone, whatever the group of near copies still needs."""
    rng = random.Random(12)
    shared = prose(rng, 60)
    texts = [prose(rng, 200) + " " + shared + " " + prose(rng, 200) for _ in range(40)] + variants(rng, prose(rng, 150), 60, lambda r: r.choice([1, 2, 3, 4]))
    rows = list(enumerate(texts))
    made, plain = [], ngram_join.map_arrow

    def counted(rows, f, schema):
        if "_best_pairs" in f.__qualname__ or "_all_pairs" in f.__qualname__:
            made.append(rows.count())
        return plain(rows, f, schema)

    monkeypatch.setattr(ngram_join, "map_arrow", counted)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    assert len(made) > 2 and all(2 * n < made[0] for n in made[1:]), made


def test_components_after_more_links(spark):
    rng = random.Random(6)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(160)] + [(7, 7), (900, 900)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    found = lambda df: sorted(tuple(r) for r in df.select("node", "label").collect())
    whole, labels = found(components(frame(links))), components(frame(links[:70]))
    assert (900, 900) in whole
    for more in (links[70:72], [], links[72:]):
        labels = ngram_join.merged(labels, frame(more))
    assert found(labels) == whole
