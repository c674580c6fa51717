"""The queries of the corpus operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_dedup
from .katz import fit_and_score
from .language_id import identify_languages
from .manifest import verified_manifest
from .merge_rounds import round_trip
from .mixing import mixing_rates
from .ngram_join import near_duplicates
from .packing import pack_documents
from .repeats import remove_repeats
from .resampling import resample
from .syncmers import compare_edited
from .toxicity import score_toxicity
from .warc import archive_pages


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token pieces in sequences of 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by a model of the labelled ones that are not held out."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of documents that share four fifths of their five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those whose crc32(doc_id) mod 5 isn't 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    _, scored = fit_and_score(docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all pages; the text model is of all documents."""
    return identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op6_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, their edited texts' and their likeness by position."""
    return compare_edited(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without strings of 200 bytes that occur elsewhere too."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays."""
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates at which all documents make up the target shares of good and poor text."""
    return mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back."""
    back = archive_pages(table(spark, sf_dir, "pages"))
    # What a response says of its payload is taken from the payload as it was read back.
    full = F.col("record_type") == "response"
    return back.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        F.col("refers_to_page").cast("long").alias("refers_to"),
    )


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by the piece model, and decoded again."""
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their weight towards the benchmark's texts, and the rank of those drawn."""
    rows = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents proven against the manifest's root, a fifth of them tampered with."""
    return verified_manifest(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keep
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM p
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 80 * (p.n + q.n - shared)
), edges AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT doc_id, y FROM reach JOIN edges ON x = other
)
SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN sizes USING (doc_id)
GROUP BY r.doc_id
"""

OP8_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

_SQL_CRC = """
poly AS (
  -- The remainders of the 256 bytes by the reflected polynomial 0xEDB88320, by eight steps of one bit.
  SELECT list(list_reduce([b, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM (SELECT unnest(range(256)) AS b)
)"""

_SQL_CRC_OF = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"""

OP12_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), """
    + _SQL_CRC.strip()
    + """, f AS (
  SELECT row, unnest(words) AS w FROM d
), g AS (
  SELECT unnest(words) AS w FROM b
), bucket AS (
  SELECT w, """
    + _SQL_CRC_OF.format("w")
    + """ % 10000 AS k
  FROM (SELECT DISTINCT w FROM f UNION SELECT DISTINCT w FROM g), poly
), own AS (
  SELECT k, count(*) AS s FROM f JOIN bucket USING (w) GROUP BY k
), other AS (
  SELECT k, count(*) AS t FROM g JOIN bucket USING (w) GROUP BY k
), totals AS (
  SELECT (SELECT count(*) FROM f)::DOUBLE AS s_all, (SELECT count(*) FROM g)::DOUBLE AS t_all
), gain AS (
  SELECT k, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS gain
  FROM (SELECT DISTINCT k FROM bucket) LEFT JOIN own USING (k) LEFT JOIN other USING (k), totals
), weights AS (
  SELECT row, sum(gain)::BIGINT AS weight FROM f JOIN bucket USING (w) JOIN gain USING (k) GROUP BY row
), scored AS (
  SELECT doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (row)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= n * 10 // 100 THEN place END AS rank FROM placed
"""
)

OP13_SQL = (
    "WITH RECURSIVE "
    + _SQL_CRC.strip()
    + """, fields AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
            || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         coalesce("""
    + _SQL_CRC_OF.format("doc_id::VARCHAR")
    + """ % 5 = 0, false) AS hit
  FROM documents, poly
), hashed AS (
  SELECT doc_id, coalesce('+' || source, '') AS key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS claimed
  FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM hashed
), up AS (
  SELECT key, 0 AS level, idx, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT key, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY key, level, idx // 16, n
), subroots AS (
  SELECT key, digest, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1
), top AS (
  SELECT 0 AS level, idx, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY level, idx // 16, n
), runs AS (
  SELECT key, level, idx // 16 AS run, list(digest ORDER BY idx) AS digests FROM up WHERE n > 1 GROUP BY key, level, idx // 16
  UNION ALL
  SELECT NULL, level, idx // 16, list(digest ORDER BY idx) FROM top WHERE n > 1 GROUP BY level, idx // 16
), climb AS (
  SELECT doc_id, leaf, key, 0 AS level, idx, claimed AS done, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, leaf, c.key, c.level + 1, c.idx // 16,
         sha256(array_to_string(digests[1:c.idx % 16], '') || done || array_to_string(digests[c.idx % 16 + 2:], '')),
         proof || array_to_string(digests[1:c.idx % 16], '') || array_to_string(digests[c.idx % 16 + 2:], '')
  FROM climb c JOIN runs r ON r.key = c.key AND r.level = c.level AND r.run = c.idx // 16
), joined AS (
  SELECT c.doc_id, c.leaf, s.digest AS subroot, s.idx, done, proof
  FROM climb c JOIN (SELECT key, max(level) AS level FROM climb GROUP BY key) m ON m.key = c.key AND m.level = c.level JOIN subroots s ON s.key = c.key
), climb_top AS (
  SELECT doc_id, leaf, subroot, 0 AS level, idx, done, proof FROM joined
  UNION ALL
  SELECT doc_id, leaf, subroot, c.level + 1, c.idx // 16,
         sha256(array_to_string(digests[1:c.idx % 16], '') || done || array_to_string(digests[c.idx % 16 + 2:], '')),
         proof || array_to_string(digests[1:c.idx % 16], '') || array_to_string(digests[c.idx % 16 + 2:], '')
  FROM climb_top c JOIN runs r ON r.key IS NULL AND r.level = c.level AND r.run = c.idx // 16
)
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, done AS folded_root, done = digest AS verified
FROM climb_top, (SELECT digest FROM top WHERE n = 1) WHERE level = (SELECT max(level) FROM top)
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_toxicity, op3_ngram_jaccard_join, op4_katz_backoff, op5_language_id, op6_closed_syncmers, op7_repeated_passages, op8_exact_dedup, op9_mixing, op10_warc, op11_sentencepiece, op12_importance_resampling, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_jaccard_join": OP3_SQL, "op8_exact_dedup": OP8_SQL, "op10_warc": OP10_SQL, "op12_importance_resampling": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
