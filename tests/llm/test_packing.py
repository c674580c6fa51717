import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trajectra.llm.packing import Sums, encoder, pack_documents, plan_packing

from .helpers import awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_length_and_overfills_nothing(seed):
    rng = random.Random(seed)
    cap = 64
    counts = {rng.randint(1, cap): rng.randint(1, 400) for _ in range(rng.randint(1, 40))}
    used = {}
    total = 0
    for items, n in plan_packing(dict(counts), cap):
        assert n > 0 and sum(items) <= cap
        total += n
        for x in items:
            used[x] = used.get(x, 0) + n
    assert used == counts
    bins: list[int] = []  # best fit, longest first
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [b for b in range(len(bins)) if bins[b] >= x]
        if fits:
            bins[min(fits, key=lambda b: bins[b])] -= x
        else:
            bins.append(cap - x)
    assert total <= 1.01 * len(bins) + 1


def test_plan_finds_exact_complements():
    plan = plan_packing({700: 3, 324: 1, 200: 2, 124: 1, 100: 1, 24: 1}, 1024)
    assert sum(n for _, n in plan) == 3


def test_sums_of_up_to_three_by_brute_force():
    from itertools import combinations_with_replacement

    rng = random.Random(3)
    for _ in range(30):
        left = np.zeros(41, np.int64)
        for _ in range(rng.randrange(1, 9)):
            left[rng.randrange(1, 41)] += rng.randrange(1, 4)
        sums = Sums(left)
        while left.any():
            gap = rng.randrange(1, 60)
            want = [c for k in (1, 2, 3) for c in combinations_with_replacement(np.flatnonzero(left).tolist(), k) if sum(c) == gap and all(left[x] >= c.count(x) for x in c)]
            got = sums.exact(gap)
            assert (got is None) == (not want) and (got is None or tuple(sorted(got)) in want and len(got) == len(want[0]))
            for x in got or [int(np.flatnonzero(left)[0])]:
                left[x] -= 1


def test_ids_are_those_of_the_tokenizer_file():
    plain, encode = Tokenizer.from_file(PATH), encoder(PATH)
    for text in ["", " ", "a  b\n\n c\t", "don't  ", "ünï 日本語 😀‍", "<|endoftext|> x", "12 345abc!!  ", "　\xa0 x", "tail \n"]:
        assert list(encode(text)) == plain.encode(text, add_special_tokens=False).ids, text


def test_pieces_and_places(spark):
    df = awkward(spark)
    plain = Tokenizer.from_file(PATH)
    rows = pack_documents(df, PATH).collect()
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        end, cuts = len(ids), [len(ids)]
        while end > 1024:
            end -= 1024
            cuts.append(end)
        starts = [0, *sorted(cuts)[:-1]]
        for n, (a, b) in enumerate(zip(starts, sorted(cuts))):
            want.append((r["doc_id"], n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert sorted(map(repr, (tuple(r)[:5] for r in rows))) == sorted(map(repr, want))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty(spark):
    assert pack_documents(empty(spark), PATH).count() == 0
