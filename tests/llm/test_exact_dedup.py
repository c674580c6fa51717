import hashlib
from collections import defaultdict

from trajectra.llm import exact_dedup as exact_dedup_module
from trajectra.llm.exact_dedup import drop_exact_duplicates, exact_dedup

from .helpers import awkward, empty


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, used = (max(known) if known else None), False
        for i in ids:
            kept = i == keep and not used
            used |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    df = awkward(spark)
    want = brute([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    got = sorted((tuple(r) for r in exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)
    assert got == want


def test_same_length_and_head_but_other_tail(spark):
    head = "h" * 5000
    df = spark.createDataFrame([(1, head + "a"), (2, head + "b"), (3, head + "a")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup(df).collect()} == {(1, 3), (2, 2), (3, 3)}


def test_dropping_keeps_columns_and_one_row_a_group(spark):
    df = awkward(spark)
    out = drop_exact_duplicates(df)
    assert out.columns == df.columns
    texts = [r[0] or "" for r in out.select("text").collect()]
    assert len(texts) == len(set(texts)) == len({r[0] or "" for r in df.select("text").collect()})


def test_a_filter_that_is_too_small_changes_nothing(spark, monkeypatch):
    """With as many keys as it has bits nearly every row passes, and is told apart by its full hash."""
    monkeypatch.setattr(exact_dedup_module, "LEAST_BITS", 6)
    monkeypatch.setattr(exact_dedup_module, "MOST_BITS", 6)
    rows = [(i, "x" * (i % 90) + str(i % 7)) for i in range(400)] + [(i, None) for i in range(400, 410)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)
    assert got == brute(rows)
    assert sorted(r["doc_id"] for r in drop_exact_duplicates(df).collect()) == sorted(i for i, _, _, kept, _ in got if kept)


def test_empty(spark):
    assert exact_dedup(empty(spark)).count() == 0
    assert drop_exact_duplicates(empty(spark)).count() == 0
