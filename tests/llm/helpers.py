"""Small tables with the cases that every operator has to take."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i:03d}" for i in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward(spark, extra: bool = True):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows, odd characters, clashing names."""
    rng = random.Random(3)
    base = prose(rng, 120)
    texts = [None, "", " \n\t ", "a", base, base, base + " tail", prose(rng, 20_000), "ä" * 700 + " 😀 　 x", prose(rng, 900), "x" * 3000, base.upper(), "<|endoftext|> and more"]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None) for i, t in enumerate(texts)]
    rows += [(4, base, "en", "s", 5), (None, base, None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        df = df.selectExpr("*", "n_chars as id", "text as length", "lang as piece", "source as kept", "doc_id as __id", "doc_id as group_size", "source as keep_id", "1 as n")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)
