"""Toxicity by compression distance: separate zstandard dictionaries of toxic and ordinary text, compared window by window.

Training reads a bounded sample of labelled rows (MAX_DOCS documents a class of at most MAX_BYTES each, chosen by
a hash of their ids; of equal texts with one label the first). They are dealt to DEALS parts by another hash of their ids, and each part has a
judge whose dictionaries are of the other parts. Byte runs that many toxic documents have and hardly any ordinary one does are the samples of
the toxic dictionary; runs that many toxic documents repeat and hardly any ordinary one does, though ordinary ones
have them, are those of a second one, the dictionary of repeated runs; windows of ordinary documents are those of the ordinary one. A window has two gains: how many
bytes shorter it gets when the toxic dictionary, or that of repeated runs, is laid over the ordinary one, in the mean of several compression
levels: which matches a level happens to find differs from level to level, a marking word's doesn't. A window that has no run of a
dictionary isn't compressed with it; its gain is 0. A judge weighs the shares of the windows whose gains reach each of several thresholds
by a logistic regression on the documents of its own part, which its dictionaries haven't seen. The score is from the mean of all judges' verdicts, set
against a cut that FLAGGED of the ordinary documents reach when only the judge that hasn't seen them is asked.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .items import map_arrow

#: Labelled rows a class, bytes of one and of all of a class that training reads at most.
MAX_DOCS, MAX_BYTES, SAMPLE_BYTES = 3000, 1 << 16, 16 << 20
#: Parts, and so judges; the share of ordinary documents that a single judge may flag (the mean of all flags fewer).
DEALS, FLAGGED = 3, 0.02
WINDOW = 40
LEVELS = (1, 3)
GRAM = 6
#: A byte run marks toxic text if this share of toxic documents has it, and it is this many times as frequent there.
LEAST_SHARE, RATIO = 0.03, 30
#: A run that isn't marking by itself can be so when a text has it this many times.
REPEATS = (2, 3)
ORDINARY_BYTES, TOXIC_BYTES = 16384, 4096
THRESHOLDS = range(1, 9)
#: Begins each window and ends each dictionary: a window always has one match, so that a marking run's isn't lost
#: because a compressed block's fixed cost is more than one match saves.
ANCHOR = b"\x00\x01anchor of windows\x02\x03"


def windows(raw: bytes, size: int = WINDOW) -> list[bytes]:
    """raw in pieces that begin at a space, of size bytes or a little more, twice that at most."""
    out, at, n = [], 0, len(raw)
    while at < n:
        end = raw.find(b" ", at + size, at + 2 * size)
        if end < 0:
            end = n if n - at <= 2 * size else at + 2 * size
        out.append(raw[at:end])
        at = end
    return out


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def _grams(raw: bytes, size: int = GRAM) -> np.ndarray:
    """The runs of size bytes, as numbers."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    if len(b) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(b) - size + 1, np.uint64)
    for i in range(size):
        out = out << np.uint64(8) | b[i : len(b) - size + 1 + i]
    return out


def _repeated(raw: bytes, times: int) -> np.ndarray:
    """The different runs that raw has times or more."""
    runs, n = np.unique(_grams(raw), return_counts=True)
    return runs[n >= times]


def marking_runs(toxic: list[bytes], ordinary: list[bytes], times: int = 1) -> np.ndarray:
    """The runs that, had times or more, tell toxic texts from ordinary ones."""
    runs, n = np.unique(np.concatenate([_repeated(x, times) for x in toxic] or [np.zeros(0, np.uint64)]), return_counts=True)
    runs, n = runs[n >= max(3, LEAST_SHARE * len(toxic))], n[n >= max(3, LEAST_SHARE * len(toxic))]
    other = np.zeros(len(runs), np.int64)
    for x in ordinary:
        other += np.isin(runs, _repeated(x, times))
    return runs[n / max(1, len(toxic)) >= RATIO * (other + 1) / max(1, len(ordinary))] if len(ordinary) > RATIO else runs[(other == 0)]


def _stretches(texts: list[bytes], marks: np.ndarray) -> list[bytes]:
    """The stretches of texts that are made of marks."""
    pieces = []
    for x in texts:
        hit = np.isin(_grams(x), marks)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
        pieces += [x[a : b + GRAM - 1] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
    return pieces


def marking_pieces(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """The stretches of toxic texts that are made of runs which tell them from ordinary texts."""
    return _stretches(toxic, marking_runs(toxic, ordinary))


def repeated_runs(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """The runs which only by being repeated tell toxic texts from ordinary ones."""
    marks = np.unique(np.concatenate([marking_runs(toxic, ordinary, times) for times in REPEATS]))
    return np.setdiff1d(marks, marking_runs(toxic, ordinary))


def _frequent(samples: list[bytes], size: int) -> bytes:
    """The most frequent samples, the most frequent last, where matches cost least."""
    return b"".join(x for x, _ in reversed(Counter(samples).most_common(500)))[-size:]


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's content; of few samples, which zstandard refuses, their most frequent ones."""
    try:
        made = zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        return _frequent(samples, size)
    # Before the content stand a header and entropy tables of no fixed length; what comes from the samples is content.
    text = b"\n".join(samples)
    return next((made[at:] for at in range(8, min(1024, len(made) - 8)) if made[at : at + 8] in text), made[8:])


@dataclass
class Judge:
    """Dictionaries and what their gains weigh."""

    ordinary: bytes
    toxic: bytes
    repeated: bytes
    weights: np.ndarray

    @functools.cached_property
    def _squeeze(self):
        def of(content: bytes, level: int):
            made = zstd.ZstdCompressionDict(content + ANCHOR, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            return zstd.ZstdCompressor(level=level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False)

        return [[of(self.ordinary + x, level) for x in (b"", self.toxic, self.repeated)] for level in LEVELS]

    def gains(self, pieces: list[bytes], hits: np.ndarray) -> np.ndarray:
        """Two rows, by the toxic dictionary and by that of repeated runs, with a column a window; hits has which windows to compress."""
        total = np.zeros((2, len(pieces)), np.int64)
        for row, hit, kind in zip(total, hits, (1, 2)):
            at = np.flatnonzero(hit)
            if len(at):
                some = [ANCHOR + pieces[i] for i in at.tolist()]
                for level in self._squeeze:
                    plain, laid = ([len(x) for x in level[k].multi_compress_to_buffer(some, threads=1)] for k in (0, kind))
                    row[at] += np.array(plain) - np.array(laid)
        return total // len(LEVELS)

    def features(self, pieces: list[bytes], hits: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """A row a text; counts has how many of the windows are each text's, one text after another."""
        gains = self.gains(pieces, hits)
        text, texts = np.repeat(np.arange(len(counts)), counts), len(counts)
        out = [np.ones(texts), np.log1p(counts)]
        for row in gains:
            reach = [np.bincount(text[row >= k], minlength=texts) for k in THRESHOLDS]
            most = np.full(texts, np.iinfo(np.int64).min)
            np.maximum.at(most, text, row)
            out += [np.sqrt(r / np.maximum(1, counts)) for r in reach] + [np.log1p(r) for r in reach] + [np.where(counts > 0, most, 0) / 10]
        return np.stack(out, axis=1)

    def __getstate__(self):
        return {"ordinary": self.ordinary, "toxic": self.toxic, "repeated": self.repeated, "weights": self.weights}


@dataclass
class ToxicityModel:
    judges: list[Judge]
    cut: float = 0.0

    @functools.cached_property
    def _runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of all dictionaries, which of them each is in, as bits, and a table of the hashes that there are."""
        found = [(_grams(x), np.uint64(1 << (2 * j + k))) for j, judge in enumerate(self.judges) for k, x in enumerate((judge.toxic, judge.repeated))]
        runs, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
        bits = np.zeros(len(runs), np.uint64)
        np.bitwise_or.at(bits, at, np.concatenate([np.full(len(g), bit) for g, bit in found]))
        table = np.zeros(1 << 20, bool)
        table[_slots(runs)] = True
        return runs, bits, table

    def windows(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        """The windows of a text, and for each judge and dictionary which of them have one of its runs."""
        raw = _raw(text)
        pieces = windows(raw)
        runs, bits, table = self._runs
        grams = _grams(raw)
        at = np.flatnonzero(table[_slots(grams)])
        place = np.minimum(np.searchsorted(runs, grams[at]), max(0, len(runs) - 1))
        at, place = (x[runs[place] == grams[at]] for x in (at, place)) if len(runs) else (at[:0], place[:0])
        ends = np.cumsum([len(x) for x in pieces])
        held = np.zeros(len(pieces), np.uint64)
        np.bitwise_or.at(held, np.searchsorted(ends, at, side="right"), bits[place])
        return pieces, np.array([held >> np.uint64(k) & np.uint64(1) for k in range(2 * len(self.judges))], bool).reshape(len(self.judges), 2, len(pieces))

    def asked(self, texts: list[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The windows of all texts, their hits as windows() gives them, and how many each text has. A call of the compressor costs
        more than a window, so it gets those of many texts at once."""
        found = [self.windows(t) for t in texts]
        hits = np.concatenate([h for _, h in found], axis=2) if found else np.zeros((len(self.judges), 2, 0), bool)
        return [x for pieces, _ in found for x in pieces], hits, np.array([len(pieces) for pieces, _ in found], np.int64)

    def verdicts(self, texts: list[str | None]) -> np.ndarray:
        """The judges' mean for each text, as the logarithm of odds."""
        pieces, hits, counts = self.asked(texts)
        return np.mean([np.clip(judge.features(pieces, own, counts) @ judge.weights, -30, 30) for judge, own in zip(self.judges, hits)], axis=0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.verdicts(texts) - self.cut, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])

    def __getstate__(self):
        return {"judges": self.judges, "cut": self.cut}


def _slots(runs: np.ndarray) -> np.ndarray:
    return (runs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 0.3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], decay)
    ridge[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = MAX_DOCS) -> ToxicityModel | None:
    """A model from the labelled rows whose crc32(id as text) mod 5 isn't 0, or None without documents of both labels.

    An id with both labels counts as toxic, and of rows that repeat an id the one with the greatest text is read; null ids, null
    labels and labels other than 0 and 1 are passed over. At most max_docs rows a class and SAMPLE_BYTES of text a class come to the driver.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    known = known.where(F.crc32(F.col("id").cast("string")) % 5 != 0).groupBy("id").agg(F.max("label").alias("label"))
    chosen = None
    for label in (1, 0):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(max_docs)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text").between(1, MAX_BYTES))
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.max("text").alias("text"))
    # Within the budget of bytes in the order of the hash; at most two times max_docs rows are added up.
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy(F.xxhash64("id"), "id"))
    rows = sample.withColumn("upto", upto).where(F.col("upto") <= SAMPLE_BYTES).select("id", "label", "text").collect()
    return fit_toxicity(sorted((r["id"], r["label"], _raw(r["text"])) for r in rows))


def _part(i: int) -> int:
    return zlib.crc32(f"part {i}".encode()) % DEALS


def _judge(toxic: list[bytes], ordinary: list[bytes]) -> Judge:
    """A judge without weights, whose dictionaries are of these documents."""
    pieces, marks = marking_pieces(toxic, ordinary), repeated_runs(toxic, ordinary)
    # Ordinary text has repeated runs too; if they or nearly all of one were in the ordinary dictionary, they would give no gain.
    near = np.union1d(marks >> np.uint64(8), marks & np.uint64((1 << 8 * (GRAM - 1)) - 1))
    plain = [w for x in ordinary for w in windows(x, 96) if not len(near) or not np.isin(_grams(w, GRAM - 1), near).any()]
    repeated = _frequent(_stretches(toxic, marks), TOXIC_BYTES // 3 - 2)
    # zstandard surely keeps only every third place of a dictionary; in three copies each run begins at one.
    repeated = (repeated + b"\n" * (1 + -len(repeated) % 3)) * 3 if repeated else b""
    listed = _dictionary([b"".join(pieces[i : i + 8]) for i in range(0, len(pieces), 8)], TOXIC_BYTES)
    return Judge(_dictionary(plain, ORDINARY_BYTES), listed, repeated, np.zeros(4 + 4 * len(THRESHOLDS)))


def fit_toxicity(rows: list[tuple[int, int, bytes]]) -> ToxicityModel | None:
    """A model from rows of id, label and text, in order of id and text. A part without documents of both labels has no judge;
    without any judge there is one of all documents, which are also weighed by it; without documents of both labels there is no model."""
    rows = list({(label, text): (i, label, text) for i, label, text in reversed(rows)}.values())[::-1]
    if {label for _, label, _ in rows} != {0, 1}:
        return None
    judges, asked = [], []
    for j in (*range(DEALS), None):
        own = [r for r in rows if j is None or _part(r[0]) == j]
        rest = [r for r in rows if j is None or _part(r[0]) != j]
        if {r[1] for r in own} != {0, 1} or {r[1] for r in rest} != {0, 1} or j is None and judges:
            continue
        judge = _judge([t for _, k, t in rest if k], [t for _, k, t in rest if not k])
        alone = ToxicityModel([judge])
        pieces, hits, counts = alone.asked([t.decode("utf-8", "replace") for *_, t in own])
        x, y = judge.features(pieces, hits[0], counts), np.array([k for _, k, _ in own], float)
        judge.weights = _logistic(x, y)
        judges.append(judge)
        asked.append((x @ judge.weights)[y == 0])
    clean = np.sort(np.concatenate(asked))[::-1]
    return ToxicityModel(judges, float(clean[int(FLAGGED * len(clean))]))


def with_score(df: DataFrame, model: ToxicityModel | None, text: str, out: str = "score") -> DataFrame:
    """df with out: the score of column text, 0 to 1; null and empty texts have one too. Without a model it is 0."""
    if model is None:
        return df.withColumn(out, F.lit(0.0))
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(place).to_pylist()) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out])

    return map_arrow(df, run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def score_toxicity(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score, predicted for every row of documents; repeated ids and null texts are scored like others. An
    empty table gives none.

    held_out is crc32(id as text) mod 5 = 0; those rows' labels aren't learnt from. A null id is not held out.
    Other columns, labels of other kinds, language and source are not read.
    """
    rows = documents.select(F.col(id_col), F.col(text_col).alias("__text"))
    rows = with_score(rows, train_toxicity(documents, labels, id_col, text_col), "__text")
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    return rows.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of documents that score below threshold, with their columns. An empty table gives none."""
    model = train_toxicity(documents, labels, id_col, text_col)
    rows = documents.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return with_score(rows, model, "text").where(F.col("score") < threshold).select("row.*")
