"""Mixing documents to target token shares of domains that are known for labelled rows only.

A classifier fitted on a bounded sample of labelled rows gives each document a posterior p over the domains.
Rates r >= 0 minimise

    1/2 sum_k (sum_d r_d n_d p_dk / S - t_k)^2 + MU/2 sum_d (n_d / S) (r_d - 1)^2

where n_d is a document's tokens, S all tokens and t the target shares: expected domain totals match the targets with
rates as near 1 as they can be. Accelerated projected gradient steps; each is one aggregation of K numbers over
the table of posteriors. A row's rate follows from its posterior and the residuals of the steps so far, so no
state is stored between steps and a lost executor costs a task.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise
from .items import blocks, hash_words, map_arrow

DOMAINS = ("good", "poor")
#: Shares of tokens to aim at.
TARGETS = (0.9, 0.1)
MU = 1e-3
MAX_DOCS, MAX_BYTES = 6000, 1 << 16
STEPS, TOLERANCE = 1000, 1e-4
_HASHED = 1 << 11
_STATS = 8


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of numbers for each text, and its words: hashed words, as unit vectors of root counts, and a few
    measures of what kinds of characters and how many repetitions it has."""
    hashes, counts = hash_words(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    bag = np.bincount(doc * _HASHED + (hashes % np.uint64(_HASHED)).astype(np.int64), minlength=len(texts) * _HASHED)
    bag = np.sqrt(bag.reshape(len(texts), _HASHED)).astype(np.float32)
    bag /= np.maximum(np.sqrt((bag**2).sum(1, keepdims=True)), 1e-9)
    order = np.lexsort((hashes, doc))
    new = np.concatenate([[True], (np.diff(hashes[order]) != 0) | (np.diff(doc[order]) != 0)])[: len(order)]
    different = np.bincount(doc[order][new], minlength=len(texts))
    stats = np.zeros((len(texts), _STATS), np.float32)
    for i, raw in enumerate(texts):
        b = np.frombuffer(raw, np.uint8)
        n = max(1, len(b))
        upper, digit = ((b >= 65) & (b <= 90)).sum(), ((b >= 48) & (b <= 57)).sum()
        mark = ((b > 32) & (b < 48)).sum() + ((b > 57) & (b < 65)).sum() + ((b > 90) & (b < 97)).sum() + ((b > 122) & (b < 128)).sum()
        w = max(1, counts[i])
        stats[i] = (np.log1p(counts[i]), different[i] / w, 10 * upper / n, 10 * digit / n, 10 * mark / n, len(b) / w / 10, 10 * (b == 10).sum() / w, counts[i] > 0)
    return np.concatenate([np.ones((len(texts), 1), np.float32), stats, bag], 1), counts


@dataclass
class DomainModel:
    weights: np.ndarray

    def posteriors(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out, words = [], []
        for i in range(0, len(texts), 256):
            x, n = features(texts[i : i + 256])
            z = x @ self.weights
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
            words.append(n)
        return (np.concatenate(out), np.concatenate(words)) if out else (np.zeros((0, self.weights.shape[1])), np.zeros(0, np.int64))


def _softmax_fit(x: np.ndarray, y: np.ndarray, k: int, steps: int = 150, decay: float = 2e-4) -> np.ndarray:
    target = np.eye(k, dtype=np.float32)[y]
    w = np.zeros((x.shape[1], k), np.float32)
    ahead, t = w.copy(), 1.0
    rate = np.float32(2.0 / max(1e-6, np.linalg.norm(x[: 2000].T @ x[: 2000] / max(1, len(x[:2000])), 2)))
    for _ in range(steps):
        z = x @ ahead
        z = np.exp(z - z.max(1, keepdims=True))
        p = z / z.sum(1, keepdims=True)
        new = ahead - rate * (x.T @ (p - target) / len(x) + decay * ahead)
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + np.float32((t - 1) / nxt) * (new - w), new, nxt
    return w


def train_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS) -> DomainModel:
    """Softmax regression on at most max_docs labelled documents of MAX_BYTES at most, chosen by a hash of their ids.

    A row's domain is good if quality = 1, else poor. Null labels and ids are passed over.
    Without labelled documents all posteriors are even.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("q")).where("id is not null and q is not null")
    known = known.groupBy("id").agg(F.max(F.when(F.col("q") == 1, 0).otherwise(1)).alias("domain"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text").between(1, MAX_BYTES))
    rows = sorted((r["id"], r["domain"], r["text"].encode("utf-8", "replace")) for r in texts.join(F.broadcast(chosen), "id").select("id", "domain", "text").collect())
    if not rows:
        return DomainModel(np.zeros((1 + _STATS + _HASHED, len(DOMAINS)), np.float32))
    return DomainModel(_softmax_fit(_matrix([r[2] for r in rows]), np.array([r[1] for r in rows]), len(DOMAINS)))


def _matrix(texts: list[bytes]) -> np.ndarray:
    """The features of texts, made a few at a time in their place: the driver holds them once."""
    out = np.empty((len(texts), 1 + _STATS + _HASHED), np.float32)
    for i in range(0, len(texts), 256):
        out[i : i + 256] = features(texts[i : i + 256])[0]
    return out


def posterior_table(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens (words) and posterior for every row of docs; a null text is an empty one."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            p, n = model.posteriors(block.texts)
            yield pa.RecordBatch.from_arrays([pa.array(block.columns["id"], pa.int64()), pa.array(n.astype(np.int64)), pa.array(list(p.astype(float)), pa.list_(pa.float64()))], names=["id", "n_tokens", "posterior"])

    return map_arrow(rows, run, "id long, n_tokens long, posterior array<double>")


def rates_after(p: np.ndarray, residuals: list[np.ndarray], mu: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates and look-ahead points of rows with posteriors p after the steps whose residuals are given."""
    r = y = np.ones(len(p))
    t, eta = 1.0, 1.0 / (1.0 + mu)
    for e in residuals:
        new = np.maximum(0.0, y - eta * (p @ e + mu * (y - 1.0)))
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        r, y, t = new, np.maximum(0.0, new + (t - 1) / nxt * (new - r)), nxt
    return r, y


def fit_rates(table: DataFrame, targets=TARGETS, mu: float = MU, steps: int = STEPS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The residuals of the steps, from which rates_after gives every row's rate. Ends when two steps in a
    row change no domain's share of tokens by more than tolerance; if steps aren't enough, it says so in a warning."""
    k = len(targets)
    target = np.array(targets, float) / sum(targets)
    whole = table.agg(F.sum("n_tokens")).first()[0] or 0
    residuals: list[np.ndarray] = []
    if not whole:
        return residuals
    before, calm = None, 0
    for _ in range(steps):
        now = list(residuals)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k)
            for batch in batches:
                if batch.num_rows:
                    p = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
                    _, y = rates_after(p, now, mu)
                    total += (y * batch.column("n_tokens").to_numpy()) @ p
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"s{i}" for i in range(k)])

        sums = table.mapInArrow(part, ", ".join(f"s{i} double" for i in range(k))).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]).first()
        share = np.array([sums[i] or 0.0 for i in range(k)]) / whole
        residuals.append(share - target)
        calm = calm + 1 if before is not None and np.abs(share - before).max() < tolerance else 0
        if calm == 2:
            return residuals
        before = share
    warnings.warn(f"rates haven't settled in {steps} steps; shares of tokens last were {before}", RuntimeWarning, stacklevel=2)
    return residuals


def mixing_rates(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets=TARGETS, mu: float = MU) -> DataFrame:
    """id_col, n_tokens, posterior (array by DOMAINS), rate, copies for every row of docs.

    copies is rate rounded up or down by a hash of the id, so that it is rate in the mean. Rows without words have
    rate 1 if the targets don't press on their posterior; null and repeated ids are rows like others. Other
    columns are not read; an empty table gives an empty result.
    """
    model = train_domains(docs, labels, id_col, text_col)
    table = materialise(posterior_table(docs, model, id_col, text_col), "posteriors")
    residuals = fit_rates(table, targets, mu)
    return table.mapInArrow(_rated(residuals, mu, len(targets)), "id long, n_tokens long, posterior array<double>, rate double").select(
        F.col("id").alias(id_col), "n_tokens", "posterior", "rate", copies_of(F.col("id"), F.col("rate")).alias("copies")
    )


def _rated(residuals: list[np.ndarray], mu: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("posterior").flatten().to_numpy().reshape(-1, k)
            rate, _ = rates_after(p, residuals, mu)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "rate"])

    return run


def copies_of(key, rate):
    """rate rounded down or up by a hash of key."""
    draw = F.pmod(F.xxhash64(F.coalesce(key, F.lit(-1)), F.lit(9)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return F.floor(rate + draw).cast("int")


def mix_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets=TARGETS, mu: float = MU) -> DataFrame:
    """The rows of docs, with their columns, each as often as its copies say: not at all, once or more often."""
    model = train_domains(docs, labels, id_col, text_col)
    residuals = fit_rates(materialise(posterior_table(docs, model, id_col, text_col), "posteriors"), targets, mu)

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, _ = model.posteriors([(t or "").encode("utf-8", "replace") for t in batch.column(2).to_pylist()])
            rate = rates_after(p.astype(float), residuals, mu)[0]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(rate, pa.float64())], names=["row", "id", "rate"])

    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = map_arrow(rows, rated, T.StructType([*rows.schema.fields[:2], T.StructField("rate", T.DoubleType())]))
    rows = rows.withColumn("copies", copies_of(F.col("id"), F.col("rate"))).where("copies > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
