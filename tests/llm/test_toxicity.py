import random
import zlib

import zstandard
from pyspark.sql import functions as F

from trajectra.llm.toxicity import ANCHOR, LEVELS, drop_toxic, fit_toxicity, marking_pieces, score_toxicity, train_toxicity, windows

from .helpers import awkward, empty, prose

INSULTS = ["blockhead", "nitwitted", "dunderbrain", "goosecap"]


def corpus(spark, n=600, seed=2):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randrange(30, 200)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(2, len(words) // 15)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = score_toxicity(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 600 and len(held) > 80
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.93
    kept = drop_toxic(docs, labels).join(labels, "doc_id").collect()
    assert sum(r["toxic"] for r in kept) < 20 and sum(1 - r["toxic"] for r in kept) > 430


def test_only_labels_outside_the_fold_are_learnt(spark):
    docs, labels = corpus(spark, 300)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = train_toxicity(docs, labels), train_toxicity(docs, turned)
    assert a.cut == b.cut and len(a.judges) == len(b.judges) == 3
    assert all(x.toxic == y.toxic and (x.weights == y.weights).all() for x, y in zip(a.judges, b.judges))


def test_awkward_rows_and_missing_labels(spark):
    docs, labels = corpus(spark, 200)
    df = awkward(spark)
    rows = score_toxicity(docs.unionByName(df.select("doc_id", "text")), labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, None, None), (10_000, 0, 1)], "doc_id long, quality int, toxic int"))).collect()
    assert len(rows) == 200 + df.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in score_toxicity(df, labels.limit(0)).collect()} == {0.0}
    out = drop_toxic(df, labels)
    assert out.columns == df.columns


def test_smaller_language_whose_sign_is_repetition(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("bcdghklmrstuvwaeiou") for _ in range(rng.randrange(3, 9))) for _ in range(400)]
    docs, labels = (x.collect() for x in corpus(spark, 800))
    for i in range(10_000, 10_300):
        words = [rng.choice(vocab) for _ in range(rng.randrange(40, 160))]
        toxic = i % 5 == 0
        for _ in range(rng.randrange(3, 7) if toxic else rng.randrange(8) == 0):
            words.insert(rng.randrange(len(words)), rng.choice(["achlich", "achliche"]) + rng.choice(vocab))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = score_toxicity(docs, labels).join(labels, "doc_id").where("held_out and doc_id >= 10000").collect()
    toxic = [r["predicted"] for r in held if r["toxic"]]
    assert len(toxic) > 5 and sum(toxic) / len(toxic) > 0.7
    assert sum(r["predicted"] for r in held if not r["toxic"]) < 0.1 * len(held)


def test_windows_and_pieces():
    raw = b"word " * 100 + b"x" * 500
    assert b"".join(windows(raw, 64)) == raw and max(map(len, windows(raw, 64))) <= 128
    toxic = [b"all fine here blockhead and there %d" % i for i in range(20)]
    pieces = marking_pieces(toxic, [b"all fine here and there %d" % i for i in range(40)])
    assert all(b"blockhead" in p for p in pieces) and len(pieces) == 20


def test_window_lengths_are_those_of_the_compressor(spark):
    """Gains against the lengths that zstandard gives for each window by itself, and none where no run is shared."""
    docs, labels = corpus(spark, 300)
    model = train_toxicity(docs, labels)
    text = docs.where("doc_id = 8").first()["text"] + " blockhead " + prose(random.Random(1), 300)
    pieces, hits = model.windows(text)
    assert b"".join(pieces) == text.lower().encode() and hits.shape == (3, 2, len(pieces)) and 0 < hits[0, 0].sum() < len(pieces)

    def length(piece, content, level):
        made = zstandard.ZstdCompressionDict(content + ANCHOR, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False).compress(ANCHOR + piece))

    for judge, own in zip(model.judges, hits):
        gains = judge.gains(pieces, own)
        for row, hit, laid in zip(gains, own, (judge.toxic, judge.repeated)):
            runs = {laid[i : i + 6] for i in range(len(laid) - 5)}
            at = 0
            for i, piece in enumerate(pieces):
                joined = text.lower().encode()[at : at + len(piece) + 5]
                assert hit[i] == any(joined[j : j + 6] in runs for j in range(min(len(piece), len(joined) - 5)))
                want = sum(length(piece, judge.ordinary, k) - length(piece, judge.ordinary + laid, k) for k in LEVELS) // len(LEVELS) if hit[i] else 0
                assert row[i] == want
                at += len(piece)


def test_a_model_of_few_documents(spark):
    """One document of a label: no part can be judged by the others, so one judge has all."""
    rows = [(1, 1, b"you blockhead " * 9)] + [(i, 0, b"all fine here %d " % i * 9) for i in range(2, 12)]
    model = fit_toxicity(rows)
    assert len(model.judges) == 1 and 0 <= model.score(None) <= 1 and 0 <= model.score("x") <= 1
    assert fit_toxicity(rows[:1]) is None and fit_toxicity([]) is None


def test_repeated_ids_among_the_labelled_rows(spark):
    docs, labels = corpus(spark, 200)
    twice = docs.unionByName(docs.limit(40)), labels.unionByName(labels.limit(40))
    assert train_toxicity(*twice).cut == train_toxicity(docs, labels).cut


def test_empty(spark):
    docs, labels = corpus(spark, 40)
    assert score_toxicity(empty(spark), labels).count() == 0
