"""Language of web pages by Bayesian fusion of text, declared language, address suffix and host.

posterior(l) ~ P(text | l) P(declared | l) P(suffix | l) P(l | host)

The text likelihood is that of hashed byte trigrams, counted by language over all labelled texts. A long text
would outweigh everything else although its trigrams aren't independent, so its mean log likelihood counts as
that of EVIDENCE trigrams at most. The other three tables come from the pages themselves: their text posteriors
are summed by declared language, suffix, host and registered domain (grouped aggregations), and P(l | host) is
smoothed towards the domain's shares, these towards all pages'. A page's own posterior is taken out of its host's
and domain's sums before they judge it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialise
from .items import blocks

BUCKETS = 1 << 14
MAX_LANGUAGES = 200
EVIDENCE = 60
#: Pages' worth of weight that the level above has in a smoothed share.
WEIGHT = 5.0


def _trigrams(raw: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of raw, A-Z as a-z and runs of anything that isn't a letter as one space."""
    b = np.frombuffer(raw.lower(), np.uint8).astype(np.int64)
    letter = (b >= 128) | ((b >= 97) & (b <= 122))
    b = np.where(letter, b, 32)
    b = b[letter | np.concatenate([[True], letter[:-1]])] if len(b) else b
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * 2654435761
    return (h >> 12) % BUCKETS


@dataclass
class TextModel:
    languages: list[str]
    log_likelihood: np.ndarray  # language x bucket

    def evidence(self, text: str | None) -> np.ndarray:
        """Log likelihoods of the languages, the largest 0; all 0 for a text without letters."""
        got = _trigrams((text or "").encode("utf-8", "replace"))
        if not len(got):
            return np.zeros(len(self.languages))
        counts = np.bincount(got, minlength=BUCKETS)
        used = np.flatnonzero(counts)
        total = self.log_likelihood[:, used] @ counts[used]
        total = total / len(got) * min(len(got), EVIDENCE)
        return total - total.max()


def train_text_model(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> TextModel:
    """Trigram counts by language over every row with a language. Null languages and texts are passed over."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for block in blocks(batches):
            for lang, text in zip(block.columns["lang"], block.texts):
                total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                total[lang] += np.bincount(_trigrams(text), minlength=BUCKETS)
        for lang, counts in total.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(counts[used])], names=["lang", "bucket", "n"])

    got = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = materialise(got, "trigrams")
    languages = sorted(r["lang"] for r in got.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    table = np.full((len(languages), BUCKETS), 0.5)
    for r in got.toLocalIterator():
        table[languages.index(r["lang"]), r["bucket"]] += r["n"]
    return TextModel(languages, np.log(table / table.sum(1, keepdims=True)))


def visible_text(html: Column) -> Column:
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(plain, r"(?s)<[^>]*>|&[a-zA-Z#0-9]+;", " ")


def declared_language(html: Column) -> Column:
    """The primary tag of <html lang=...>, lower case; null if there is none."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,8})", 1)
    return F.when(found != "", F.lower(found))


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return F.when(found != "", found)


#: Second-level labels under which names are registered in two-letter domains (a.co.uk, b.com.br).
SECOND_LEVEL = "ac|co|com|edu|gob|gov|gouv|mil|ne|net|or|org"


def registered_domain(host: Column) -> Column:
    """The last two labels of a host, or three under a second-level label; empty for a host of one label."""
    return F.regexp_extract(host, rf"(?:^|\.)([^.]+\.(?:(?:{SECOND_LEVEL})\.[a-z]{{2}}|[^.]+))$", 1)


def _spread(n: int, name: str) -> list[Column]:
    return [F.sum(F.get(F.col(name), F.lit(i))) for i in range(n)]


def identify_languages(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """id_col, host, declared, language, probability, text_language, posterior (array, by the languages' names in
    order) for every row of pages.

    Null urls and html, pages without text and unknown declarations bring no evidence of their kind. Ties go to
    the first language by name. Repeated ids are rows of their own; null ids stay null. Without labelled texts
    language is null; an empty table gives none. More than MAX_LANGUAGES languages raise ValueError. Other columns are not read.
    """
    model = train_text_model(docs, lang_col, text_col)
    k = len(model.languages)
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), declared_language(F.col(html_col)).alias("declared"), visible_text(F.col(html_col)).alias("text"))
    if not k:
        nothing = {"language": "string", "probability": "double", "text_language": "string", "posterior": "array<double>"}
        return rows.select(F.col("id").alias(id_col), "host", "declared", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])

    @F.pandas_udf("array<double>")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.evidence(t) for t in texts])

    rows = rows.withColumn("evidence", evidence("text")).drop("text")
    rows = rows.withColumns({"suffix": F.regexp_extract("host", r"\.([^.]+)$", 1), "domain": registered_domain(F.col("host"))})
    total = F.aggregate("evidence", F.lit(0.0), lambda a, x: a + F.exp(x))
    rows = materialise(rows.withColumn("own", F.transform("evidence", lambda x: F.exp(x) / total)), "evidence")
    n_rows = rows.count()

    def shares(key: str) -> DataFrame:
        known = rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
        sums = known.groupBy(key).agg(F.array(*_spread(k, "own")).alias(f"{key}_sum"), F.count(F.lit(1)).alias(f"{key}_n"))
        return materialise(sums, key)

    everything = rows.agg(F.array(*_spread(k, "own")).alias("s")).first()["s"] or [0.0] * k
    prior = (np.array([x or 0.0 for x in everything]) + 1) / (sum(x or 0.0 for x in everything) + k)
    prior_col = F.array(*[F.lit(float(x)) for x in prior])
    for key in ("host", "domain", "suffix", "declared"):
        rows = attach(rows, shares(key), [key], f"{key}_n", n_rows)

    def smoothed(key: str, above: Column) -> Column:
        """Shares of a key without the row's own part, smoothed towards above."""
        sums, n = F.col(f"{key}_sum"), F.coalesce(F.col(f"{key}_n") - 1, F.lit(0))
        return F.transform(above, lambda p, i: (F.coalesce(F.get(sums, i) - F.get("own", i), F.lit(0.0)) + F.lit(WEIGHT) * p) / (n + F.lit(WEIGHT)))

    rows = rows.withColumn("by_domain", smoothed("domain", prior_col)).withColumn("by_host", smoothed("host", F.col("by_domain")))
    # P(value | l) is in proportion to P(l | value) / P(l).
    rows = rows.withColumns({c: smoothed(c, prior_col) for c in ("suffix", "declared")} | {"__declared": F.col("declared")})
    fused = F.transform("evidence", lambda x, i: x + F.log(F.get("by_host", i)) + F.log(F.get("suffix", i)) + F.log(F.get("declared", i)) - 2 * F.log(F.get(prior_col, i)))
    rows = rows.withColumn("fused", fused).withColumn("most", F.array_max("fused"))
    rows = rows.withColumn("odds", F.transform("fused", lambda x: F.exp(x - F.col("most"))))
    rows = rows.withColumn("mass", F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)).withColumn("posterior", F.transform("odds", lambda x: x / F.col("mass")))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    return rows.select(F.col("id").alias(id_col), "host", F.col("__declared").alias("declared"), best("posterior").alias("language"), F.array_max("posterior").alias("probability"), best("own").alias("text_language"), "posterior")
