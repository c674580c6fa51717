import random

import numpy as np

from trajectra.llm.mixing import MU, features, fit_rates, mix_documents, mixing_rates, posterior_table, rates_after, train_domains

from .helpers import awkward, empty, prose


def corpus(spark, n=400):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        good = i % 5 != 0
        text = prose(rng, rng.randrange(20, 120))
        docs.append((i, text if good else " ".join(w.upper() + "!!" for w in text.split())))
        if i % 3:
            labels.append((i, int(good), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_totals_match_targets(spark):
    docs, labels = corpus(spark)
    rows = mixing_rates(docs, labels).collect()
    p, n, r = np.array([x["posterior"] for x in rows]), np.array([x["n_tokens"] for x in rows]), np.array([x["rate"] for x in rows])
    right = sum((x["posterior"][1] > 0.5) == (x["doc_id"] % 5 == 0) for x in rows)
    assert right / len(rows) > 0.97 and (r >= 0).all()
    share = (r * n) @ p / n.sum()
    assert np.abs(share - [0.9, 0.1]).max() < 0.005
    assert all(x["copies"] in (int(np.floor(x["rate"])), int(np.floor(x["rate"])) + 1) for x in rows)
    out = mix_documents(docs, labels)
    assert out.columns == docs.columns and sorted(x["doc_id"] for x in out.collect()) == sorted(x["doc_id"] for x in rows for _ in range(x["copies"]))


def test_steps_are_projected_gradient(spark):
    """Against the same problem solved with all rows in one place."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([2, 1], 50)
    n = rng.integers(1, 100, 50)
    df = spark.createDataFrame([(i, int(k), [float(x) for x in q]) for i, (k, q) in enumerate(zip(n, p))], "id long, n_tokens long, posterior array<double>").repartition(4)
    rate, _ = rates_after(p, fit_rates(df, (0.9, 0.1), steps=400, tolerance=1e-9), MU)
    r = np.ones(50)
    for _ in range(20_000):
        e = (r * n) @ p / n.sum() - np.array([0.9, 0.1])
        r = np.maximum(0, r - (p @ e + MU * (r - 1)) / (1 + MU))
    assert np.abs(rate - r).max() < 0.02


def test_rates_that_have_not_settled_are_told(spark):
    import pytest

    df = spark.createDataFrame([(0, 5, [0.9, 0.1]), (1, 50, [0.2, 0.8])], "id long, n_tokens long, posterior array<double>")
    with pytest.warns(RuntimeWarning, match="settled"):
        fit_rates(df, (0.9, 0.1), steps=2)


def test_posteriors_by_brute_force(spark):
    """The classifier's numbers for whole texts, in blocks, as for each text alone."""
    docs, labels = corpus(spark, 60)
    model = train_domains(docs, labels)
    rows = {r["id"]: r for r in posterior_table(docs, model).collect()}
    for r in docs.collect():
        x, n = features([r["text"].encode()])
        z = x[0] @ model.weights
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(rows[r["doc_id"]]["posterior"], p, atol=1e-5) and rows[r["doc_id"]]["n_tokens"] == len(r["text"].split()) == n[0]


def test_awkward_rows(spark):
    docs, labels = corpus(spark, 100)
    df = awkward(spark)
    rows = mixing_rates(df, labels.limit(0)).collect()
    assert len(rows) == df.count() and all(r["rate"] >= 0 for r in rows)
    both = docs.unionByName(df.select("doc_id", "text"))
    assert mixing_rates(both, labels).count() == both.count()
    assert mix_documents(df, labels).columns == df.columns


def test_empty(spark):
    _, labels = corpus(spark, 40)
    assert mixing_rates(empty(spark), labels).count() == 0


def test_the_matrix_is_held_once():
    import tracemalloc

    from trajectra.llm import mixing

    rng = random.Random(4)
    texts = [prose(rng, 30).encode() for _ in range(4000)]
    features(texts[:1])  # makes the tables of the word hashes
    tracemalloc.start()
    x = mixing._matrix(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1.6 * x.nbytes
    assert np.array_equal(x, np.concatenate([features(texts[i : i + 256])[0] for i in range(0, len(texts), 256)]))
