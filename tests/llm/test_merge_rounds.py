import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from trajectra.llm import merge_rounds as merges
from trajectra.llm.merge_rounds import decode, decode_ids, encode, encode_texts, load, round_trip, texts_of

from .helpers import awkward, empty

PATH = public_tokenizers.path("piece_bpe_32k.model")
OWN = sentencepiece.SentencePieceProcessor(model_file=PATH)
DOCS = "/root/testdata/sf0.001/documents.parquet"


def lists(texts):
    ids, counts = encode(load(PATH), texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []


def check(texts):
    want = [OWN.encode(t or "") for t in texts]
    assert lists(texts) == want
    flat = np.array([i for x in want for i in x], np.int64)
    assert decode(load(PATH), flat, np.array([len(x) for x in want], np.int64)) == [OWN.decode(x) if x else "" for x in want]


def test_documents_as_the_library(spark):
    check([r["text"] for r in spark.read.parquet(DOCS).collect()])


def test_odd_texts():
    rng = random.Random(5)
    check([None, "", " ", "  ", "a", " a", "a ", "\n\t", "▁", "▁▁ x▁y", "<s></s><unk><0x0A>", "\x00a\x00", "😀 你好吗 \U0010ffff﻿", "é", "ab" * 50, "banana" * 9, "=" * 77, " " * 300, "x" * 700 + " y", "  　", "�"])
    check(["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 400))) for alphabet in ("ab", "aAbB ", "thean ", "0123456789", "-=_. ", "äöüß e", "の人日本語", "abcdefghijklmnopqrstuvwxyz") for _ in range(25)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=80), max_size=5))
def test_any_text(texts):
    check(texts)


def test_long_words_in_blocks(monkeypatch):
    """Words without a cut, of many blocks, as those of one block."""
    rng = random.Random(6)
    texts = ["".join(rng.choice("etaoinshrdlucmfw") for _ in range(n)) for n in (65, 100, 129, 1000, 5000)] + ["the" * 400, "abab" * 100 + "a" * 333, " " * 700 + "word" * 70]
    check(texts)
    monkeypatch.setattr(merges, "BLOCK", 17)
    check(texts)


class Tiny(merges.PieceModel):
    """A model of given pieces, most wanted first; their scores may be equal."""

    def __init__(self, pieces, scores):
        letters = sorted({c for p in pieces for c in p})
        every = [*pieces, *letters]
        merged = {p: i for i, p in enumerate(every)}
        self.n_pieces = self.n_symbols = len(every)
        self.outside, self.prefix = np.zeros(0, np.int64), False
        self._characters(merged, merged)
        self._pairs(merged, merged, [*scores, *[-1e6] * len(letters)])
        self.pieces, self.scores = merged, [*scores, *[-1e6] * len(letters)]


def one_at_a_time(model, text):
    """The best pair, the leftmost of equals, again and again."""
    parts = list(text)
    while True:
        found = [(-model.scores[model.pieces[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.pieces]
        if not found:
            return [model.pieces[x] for x in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(60))
def test_pieces_in_any_order_of_rank(seed, monkeypatch):
    """Vocabularies that no training gives: a pair may rank after what it makes, and ranks may be equal."""
    rng = random.Random(seed)
    pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 6))) for _ in range(40)})
    rng.shuffle(pieces)
    model = Tiny(pieces, [-float(rng.randint(0, 12)) for _ in pieces])
    words = ["".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    for block in (merges.BLOCK, 13):
        monkeypatch.setattr(merges, "BLOCK", block)
        symbols = np.array([model.pieces[c] for w in words for c in w], np.int64)
        out, counts = merges.merge_rounds(model, symbols, np.array([len(w) for w in words]))
        assert [x.tolist() for x in np.split(out, np.cumsum(counts)[:-1])] == [one_at_a_time(model, w) for w in words]


def test_words_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(merges, "_ODD", np.uint64(0))
    code = np.frombuffer("abcabdabc".encode("utf-32-le"), np.uint32)
    starts, sizes, which = merges._distinct(code, np.array([0, 3, 6]), np.array([3, 3, 3]))
    assert ["".join(map(chr, code[a : a + n])) for a, n in zip(starts[which], sizes[which])] == ["abc", "abd", "abc"]


def test_any_ids_decode_as_the_library(spark):
    rng = random.Random(7)
    rows = [[rng.randrange(32000) for _ in range(rng.randint(1, 40))] for _ in range(200)] + [[rng.randrange(3, 259) for _ in range(12)] for _ in range(200)]
    rows += [[1, 2, 28705], [0, 28705], [259, 259], [13, 28705, 1], [3, 28705]]
    got = decode_ids(spark.createDataFrame([(x,) for x in rows], "ids array<int>").coalesce(1), PATH).collect()
    assert [(list(r["ids"]), r["decoded"]) for r in got] == [(x, OWN.decode(x)) for x in rows]
    out = decode_ids(spark.createDataFrame([([],), (None,)], "ids array<int>"), PATH).collect()
    assert [r["decoded"] for r in out] == ["", ""]
    with pytest.raises(Exception, match="outside the model"):
        decode_ids(spark.createDataFrame([([32000],)], "ids array<int>"), PATH).collect()


def test_awkward_rows(spark):
    df = awkward(spark)
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = OWN.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(OWN.decode(ids).encode() if ids else b"").hexdigest()))
    got = [tuple(r) for r in round_trip(df, PATH).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    kept = encode_texts(df.withColumnRenamed("id", "ids_"), PATH)
    assert kept.columns == [*df.withColumnRenamed("id", "ids_").columns, "ids"] and kept.count() == df.count()


def test_bytes_that_are_no_utf8():
    column = pa.Array.from_buffers(pa.string(), 2, [None, pa.array([b"a\xffb", b"ok"]).buffers()[1], pa.array([b"a\xffb", b"ok"]).buffers()[2]])
    assert texts_of(column) == ["a�b", "ok"]


def test_empty(spark):
    assert round_trip(empty(spark), PATH).count() == 0
    assert lists([]) == [] and lists(["", None]) == [[], []]


def test_other_models_are_refused(monkeypatch):
    class Other:
        def __init__(self, model_file):
            pass

        def serialized_model_proto(self):
            return b""

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Other)
    with pytest.raises(ValueError, match="model of merges"):
        merges.PieceModel("x")
