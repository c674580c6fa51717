import random

import corpus_pipeline

from .helpers import DOCS, awkward, empty, prose
from .test_ngram_join import brute
from .test_toxicity import INSULTS


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(300):
        words = prose(rng, rng.randrange(40, 200)).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(2, len(words) // 15)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        docs.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(400 + i, docs[3 * i + 1][1], "en", "s", 0) for i in range(20)]
    docs += [(500 + i, docs[3 * i + 1][1] + " tail", "en", "s", 0) for i in range(20)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "best_fit_packing"]
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/{k}")
        at = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append([(r["doc_id"], r["text"]) for r in at.select("doc_id", "text").collect()])
    toxic = {i for i, _, t in labels if t}
    assert len([i for i, _ in seen[0] if i in toxic]) <= 6 and len([i for i, _ in seen[0] if i not in toxic and i < 300]) > 220
    last = {}
    for i, text in seen[0]:
        last[text] = max(i, last.get(text, i))
    assert sorted(seen[1]) == sorted((i, t) for t, i in last.items())
    assert sorted(i for i, _ in seen[2]) == sorted(i for i, _, c in brute(seen[1]) if i == c)
    assert {i for i, _ in seen[3]} <= {i for i, _ in seen[2]}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == {i for i, _ in seen[3]} and all(r["length"] <= 1024 for r in rows)


def test_awkward_and_empty_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing column names, and no rows at all."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, docs in (("some", awkward(spark)), ("none", empty(spark))):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        at = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, at, f"{tmp_path}/{name}")
            assert out.columns == at.columns
            out.write.parquet(f"{tmp_path}/{name}/{k}")
            at = spark.read.parquet(f"{tmp_path}/{name}/{k}")
        rows = corpus_pipeline.STAGES[-1][1](spark, at, f"{tmp_path}/{name}").collect()
        assert sorted(repr(r["doc_id"]) for r in rows if r["piece"] == 0) == sorted(repr(r["doc_id"]) for r in at.select("doc_id").collect())
        assert bool(rows) == (name == "some")
