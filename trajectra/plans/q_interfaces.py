"""Rules called from SQL, prompt templates, metrics gathered while a batch is written, event files, micro-batches of several ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.template import render
from ..operators import batch, partition
from ..runtime import new_folder
from ..sources import event_files, observed
from . import rules
from .sql_rules import register_rules
from .views import TOKENS, TRAJ, events, rounded, sequences, table, trajectories

_CAP = 60


def _observed(spark, d):
    """A row a user, written as a batch; the record of its rows and tokens comes from that write alone."""
    rows = sequences(spark, d).select(
        "row_id",
        F.aggregate("rewards", F.lit(0.0), lambda s, x: s + x).alias("score"),
        F.size("mask").alias("length"),
        F.col("rewards").alias("advantages"),
        F.zip_with("rewards", "values", lambda r, v: r + v).alias("returns"),
        "values",
        "mask",
    )
    tokens = observed.TokenReport({"advantages": "advantages", "returns": "returns", "values": "values"})
    record = {**observed.spread("score", F.col("score")), **observed.length_report("length", "length", _CAP), **tokens.record(), **tokens.explained("returns", "values"), **observed.size_report(rows, ["row_id", "mask"])}
    got = observed.write_observed(rows, lambda df: df.write.parquet(new_folder(spark)), record, tokens)
    names = {k: k.replace("/", "_") for k in got}
    whole = ("rows", "bytes/row_id", "bytes/mask", "length/max", "length/min")
    out = spark.createDataFrame([tuple(got.values())], ", ".join(f"{n} {'bigint' if k in whole else 'double'}" for k, n in names.items()))
    return rounded(out, *out.columns)


_TEMPLATE = """{# one turn #}
{%- if role == 'user' -%}
Q{{ turn }}: {{ text | trim }}
{%- elif role == 'assistant' and text -%}
A: {{ text | replace('a', 'o') }}
{%- else -%}
[{{ role | default('none') }}]
{%- endif %}
{% for w in words %}{{ loop.index }}.{{ w }}{% if not loop.last %}, {% endif %}{% endfor %} ({{ words | length }})
"""


def _template(spark, d):
    c = table(spark, d, "conversations").withColumn("words", F.split("text", " "))
    return render(c, _TEMPLATE).select("conv_id", "turn", "prompt")


def _sql_rule(query):
    def run(spark, d):
        register_rules(spark)
        return rounded(*query(spark, trajectories(spark, d)))

    return run


def _sql_batches(spark, t):
    asked = "SELECT * FROM batch_rule(TABLE({t}) PARTITION BY uid ORDER BY row_id, rule => :rule, outputs => 'share')"
    return spark.sql(asked, {"rule": f"{rules.__file__}:share_of_longest"}, t=t.select("row_id", "uid", "len")), "row_id", "share"


def _sql_rows(spark, t):
    asked = "SELECT * FROM row_rule(TABLE({t}), rule => :rule, outputs => 'overall')"
    return spark.sql(asked, {"rule": f"{rules.__file__}:answer_and_format"}, t=t.select("row_id", "acc", "fmt")), "row_id", "overall"


def _event_file(spark, d):
    """A record for every hundred events, written as event files and read back."""
    at = new_folder(spark)
    steps = events(spark, d).groupBy(F.floor(F.col("event_id") / 100).alias("step")).agg(F.count(F.lit(1)).alias("events/all"), F.sum("k").alias("events/k"), F.count(F.when(F.col("event_type") == "purchase", 1)).alias("events/purchases"))
    event_files.write_events(steps, at)
    return event_files.read_events(spark, at).select("step", "tag", F.col("value").cast("double").alias("value"))


def _together(spark, d):
    """All documents, padded to whole steps of four ranks of 64 rows: how many parts each rank's batch got, and what they hold."""
    docs = batch.with_row_id(table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("length")), "doc_id", "length")
    rows = batch.batches(batch.pad_to_multiple(docs, 256), 64, drop_last=False).withColumn("step", F.floor(F.col("batch_id") / 4))
    parts = partition.micro_batches(rows, 20_000, together="step").join(rows.select("batch_id", "row_id", "length"), ["batch_id", "row_id"])
    each = parts.groupBy("batch_id", "part").agg(F.sum("length").alias("s"))
    return each.groupBy("batch_id").agg(F.count(F.lit(1)).alias("parts"), F.sum("s").alias("tokens"))


QUERIES = {
    "q_observed_step": _observed,
    "q_template": _template,
    "q_sql_batch_rule": _sql_rule(_sql_batches),
    "q_sql_row_rule": _sql_rule(_sql_rows),
    "q_event_files": _event_file,
    "q_micro_together": _together,
}


def _token_sql(name: str, c: str) -> str:
    return f"round(avg({c}) FILTER (mask > 0), 6) + 0.0 AS {name}_mean, round(max({c}) FILTER (mask > 0), 6) + 0.0 AS {name}_max, round(min({c}) FILTER (mask > 0), 6) + 0.0 AS {name}_min"


SQL = {
    "q_observed_step": f"""
WITH {TOKENS}, u AS (SELECT row_id, sum(r) AS score, count(*) AS length FROM tokens GROUP BY row_id),
a AS (SELECT round(avg(score), 6) + 0.0 AS score_mean, round(max(score), 6) + 0.0 AS score_max, round(min(score), 6) + 0.0 AS score_min, round(avg(length), 6) AS length_mean, max(length) AS length_max, min(length) AS length_min,
  round(avg(CAST(length = {_CAP} AS DOUBLE)), 6) AS length_clip_ratio, count(*) AS rows, count(*) * 8 AS bytes_row_id, sum(length)::BIGINT * 8 AS bytes_mask FROM u),
t AS (SELECT {_token_sql('advantages', 'r')}, {_token_sql('returns', 'r + v')}, {_token_sql('values', 'v')}, round(1.0 - var_samp(r + v - v) FILTER (mask > 0) / (var_samp(r + v) FILTER (mask > 0) + 1e-5), 6) + 0.0 AS vf_explained_var FROM tokens)
SELECT * FROM a, t""",
    "q_template": r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(string_split(text, ' '), []) AS words FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'Q' || turn || ': ' || regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN role = 'assistant' AND text <> '' THEN 'A: ' || replace(text, 'a', 'o') ELSE '[' || coalesce(role, 'none') || ']' END
  || chr(10) || coalesce(array_to_string(list_transform(words, lambda w, i: i || '.' || w), ', '), '') || ' (' || len(words) || ')' AS prompt
FROM c""",
    "q_sql_batch_rule": f"WITH {TRAJ} SELECT row_id, round(len / max(len) OVER (PARTITION BY uid), 6) AS share FROM traj",
    "q_sql_row_rule": f"WITH {TRAJ} SELECT row_id, round(acc + 0.1 * fmt, 6) AS overall FROM traj",
    "q_event_files": """
WITH s AS (SELECT event_id // 100 AS step, count(*)::DOUBLE AS n, sum(CAST(props->>'$.k' AS DOUBLE)) AS k, (count(*) FILTER (event_type = 'purchase'))::DOUBLE AS p FROM events GROUP BY 1)
SELECT step, 'events/all' AS tag, n AS value FROM s UNION ALL SELECT step, 'events/k', k FROM s WHERE k IS NOT NULL UNION ALL SELECT step, 'events/purchases', p FROM s""",
    "q_micro_together": """
WITH c AS (SELECT row_number() OVER (ORDER BY doc_id, length) - 1 AS row_id, length, count(*) OVER () AS n FROM (SELECT doc_id, coalesce(n_chars, 0) AS length FROM documents)),
g AS (SELECT unnest(generate_series(0, (SELECT ceil(max(n) / 256)::BIGINT * 256 - 1 FROM c))) AS i),
b AS (SELECT i // 64 AS batch_id, sum(length)::BIGINT AS tokens, least(count(*), greatest(1, ceil(sum(length) / 20000)))::BIGINT AS k FROM g JOIN c ON c.row_id = i % c.n GROUP BY 1)
SELECT batch_id, max(k) OVER (PARTITION BY batch_id // 4) AS parts, tokens FROM b""",
}
