"""Metric records and the text features of prompts and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar, text
from ..operators import metrics
from ..sources import prompts, sinks
from .views import TRAJ, events, rounded, table, tokens, trajectories



def _lengths(spark, d):
    c = table(spark, d, "conversations").select(F.length("role").alias("prompt_length"), F.length("text").alias("response_length"))
    return rounded(metrics.length_metrics(c, "prompt_length", "response_length", 9, 200), *_LENGTHS)


_LENGTHS = [f"{k}_length_{s}" for k in ("prompt", "response") for s in ("mean", "max", "min", "clip_ratio")]


def _data(spark, d):
    rows = events(spark, d).select((F.col("value") / 97).alias("score"), (F.col("value") / 89).alias("reward"))
    toks = tokens(spark, d).where("mask > 0").select(F.col("r").alias("advantage"), (F.col("r") + F.col("v")).alias("ret"), F.col("v").alias("value"))
    out = metrics.data_metrics(rows, toks, critic=True)
    return rounded(out, *out.columns)


#: Sections by an event's user, the last without a token count.
_SECTIONS = ("gen", "reward", "ref", "old", "values", "adv", "update_critic", "update_actor", "save")


def _timing(spark, d):
    """Events as timed sections; their k are tokens, of responses where something was bought."""
    e = events(spark, d)
    section = F.element_at(F.array(*map(F.lit, _SECTIONS)), (F.col("user_id") % len(_SECTIONS) + 1).cast("int"))
    times = e.groupBy(section.alias("section")).agg(F.sum("value").alias("seconds"))
    counts = [e.agg(F.sum(x)).scalar() for x in (F.when(F.col("event_type") == "purchase", F.col("k")), F.col("k"))]
    return rounded(metrics.timing_per_token(times, *counts), "section", "seconds", "ms_per_token")


def _flops(spark, d):
    docs = table(spark, d, "documents").select(F.col("n_chars").alias("n"))
    return docs.agg(scalar.flops(F.col("n"), 3e9, 36, 16, 128).alias("flops"), metrics.throughput(F.sum("n"), F.lit(12.5), 8).alias("throughput"))


def _validation(spark, d):
    return rounded(metrics.validation_scores(events(spark, d), "event_type", "value"), "event_type", "score", "all_sets")


def _best(spark, d):
    e = events(spark, d).select(F.col("event_type").alias("val_name"), F.col("event_id").alias("step"), F.floor("value").cast("double").alias("score"))
    return metrics.best_so_far(e)


def _responses(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'")
    made = F.concat(F.lit("<think>"), F.col("text"), F.lit("</think> "), F.when(F.col("turn") % 3 == 0, F.lit("none")).otherwise(F.lit("\\boxed{7}\n")))
    return c.select("conv_id", "turn", made.alias("response"))


def _format(spark, d):
    r = _responses(spark, d)
    return r.select("conv_id", "turn", text.format_score(F.col("response")).alias("format"), F.length("response").alias("chars"))


def _normalise(spark, d):
    r = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit(" < think >\t"), F.col("text"), F.lit("\n< / think > x / y")).alias("response"))
    return r.select("conv_id", "turn", text.normalise_tags(F.col("response")).alias("response"))


def _answers(spark, d):
    """Answers made of a text's length n and the place of its conversation: c, m and e, which is 1 where the truth is missed."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"), (F.col("conv_id") % 3 + 2).alias("m"))
    return c.withColumns({"c": F.col("n") % 5 + 1, "e": (F.col("n") % 3 == 0).cast("int"), "kind": (F.col("conv_id") + F.col("turn")) % 4})


def _accuracy(spark, d):
    """Quadratics against their factors, fractions against decimals, quotients against what they reduce to, and no box."""
    c, m, e, n, kind = (F.col(x) for x in ("c", "m", "e", "n", "kind"))
    shown = lambda form, *values: F.format_string(form, *[v.cast("long") for v in values])
    response = (
        F.when(kind == 0, shown("So \\boxed{x^2 + %dx + %d}.", c + m + e, c * m))
        .when(kind == 1, shown("\\boxed{9} or \\boxed{\\frac{%d}{4}}", n))
        .when(kind == 2, shown("\\boxed{\\dfrac{(%dx+%d)^2 - %d}{%dx + %d - %d}}", m, c, m * m, m, c, m))
        .otherwise(shown("It is x + %d.", c))
    )
    truth = F.when(kind == 0, shown("(x+%d)(%d + x)", c, m)).when(kind == 1, F.format_string("%.2f", (n + e) / 4)).when(kind == 2, shown("\\boxed{%d + %d*x}", c + m + e, m)).otherwise(shown("x+%d", c))
    return _answers(spark, d).select("conv_id", "turn", text.accuracy_score(response, truth).alias("accuracy"))


def _votes(spark, d):
    """The answers of each conversation, written in four ways, grouped by what they mean: how many there are and the most votes."""
    half, way = F.col("n") % 4, F.col("turn") % 4
    plain = half.cast("string")
    written = F.when(way == 0, F.concat(plain, F.lit("/2"))).when(way == 1, F.format_string("\\boxed{%.1f}", half / 2)).when(way == 2, F.concat(F.lit("\\frac{"), plain, F.lit("}{2}"))).otherwise(F.concat(F.lit("x = "), (half * 50).cast("string"), F.lit("\\%")))
    votes = _answers(spark, d).select("conv_id", text.answer_form(written).alias("form")).groupBy("conv_id", "form").count()
    return votes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("answers"), F.max("count").alias("votes"))


def _parts(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'").withColumn("prompt", F.concat(F.lit("<image>"), F.col("text"), F.when(F.col("turn") == 0, F.lit("<image>?")).otherwise(F.lit(""))))
    parts = text.content_parts(text.render_prompt(F.col("prompt"), " Reason."), "<image>", "image")
    return c.select("conv_id", "turn", F.array_join(F.transform(parts, lambda p: F.concat(p["type"], F.lit("="), F.coalesce(p["text"], F.lit("")))), "|").alias("parts"))


def _train_prompts(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    made = c.select(F.when(F.col("turn") == 0, F.concat(F.lit("<image>\n"), F.col("text"))).otherwise(F.col("text")).alias("question"), F.lit("\\boxed{1}").alias("answer"), F.array(F.lit("a.png")).alias("image"), F.col("conv_id").cast("string").alias("qid"))
    return prompts.training_prompts(made).select("question", "qid", "lacked_marker")


def _val_prompts(spark, d):
    p = table(spark, d, "part")
    made = p.select("p_partkey", F.col("p_name").alias("question"), F.col("p_brand").alias("answer"), F.when(F.col("p_size") % 2 == 0, F.array("p_type", "p_brand", "p_name")).otherwise(F.array().cast("array<string>")).alias("options"))
    return prompts.validation_prompts(made).select("p_partkey", "question", "answer")


def _paths(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("/abs/")).otherwise(F.lit("")), F.col("p_name")).alias("path"))
    return p.select("p_partkey", text.resolve_path(F.col("path"), "/data/").alias("path"))


def _overlong(spark, d):
    docs = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("question"))
    return prompts.without_overlong(docs, 20).select("conv_id", "turn", "n_tokens")


def _overlong_tokens(spark, d):
    """The overlong filter as a model's prompt is counted: chat template, then a tokenizer's ids."""
    import public_tokenizers

    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"), F.lit("x").alias("answer"), F.array(F.lit("a.png")).alias("image"), F.array().cast("array<string>").alias("videos"))
    rows = prompts.chat_messages(asked, " Reason.")
    rows = rows.withColumn("prompt", prompts.chat_prompt(F.col("messages")))
    kept = prompts.without_overlong(rows, 60, "prompt", prompts.file_tokenizer(public_tokenizers.path("byte_bpe_50k.json")))
    return kept.select("conv_id", "turn", "prompt", "n_tokens")


def _resize(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 61 + 13).alias("w"), (F.col("p_partkey") % 997 + 5).alias("h"))
    w, h = scalar.resized(F.col("w"), F.col("h"), 40_000, 600_000)
    return p.select("p_partkey", w.cast("long").alias("w"), h.cast("long").alias("h"))


def _warmup(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalar.warmup(F.col("c_custkey"), 64).alias("rate"), scalar.ceil_div(F.col("c_custkey"), F.lit(7)).cast("long").alias("parts"))


def _retention(spark, d):
    paths = table(spark, d, "region").select(F.concat(F.lit("/ck/global_step_"), (F.col("r_regionkey") * 10).cast("string")).alias("path"))
    return sinks.obsolete_checkpoints(paths.unionByName(spark.createDataFrame([("/ck/other",)], "path string")), 40, 10, 2).select("path", "step")


def _metric_line(spark, d):
    row = table(spark, d, "region").agg(F.max("r_regionkey").alias("val/top"), F.min("r_regionkey").alias("val/low"), F.count(F.lit(1)).alias("rows")).withColumn("step", F.lit(3))
    return sinks.metric_line(row).withColumnRenamed("value", "line")


def _variance(spark, d):
    return rounded(metrics.masked_variance(tokens(spark, d), "r", "mask"), "var")


QUERIES = {
    "q_reduce_metrics": lambda spark, d: rounded(metrics.reduce_metrics(trajectories(spark, d), ["acc", "mar", "len"]), "acc", "mar", "len"),
    "q_masked_mean": lambda spark, d: rounded(tokens(spark, d).agg(metrics.masked_mean(None, "r", "mask").alias("mean")), "mean"),
    "q_masked_var": _variance,
    "q_length_metrics": _lengths,
    "q_data_metrics": _data,
    "q_timing": _timing,
    "q_flops": _flops,
    "q_validation": _validation,
    "q_best_scores": _best,
    "q_batch_means": lambda spark, d: rounded(metrics.batch_means(trajectories(spark, d), "uid", ["len"]), "len"),
    "q_append_values": lambda spark, d: metrics.append_values(events(spark, d), "user_id", "event_id", "k").select("user_id", F.array_join(F.transform("k", lambda x: x.cast("long").cast("string")), ",").alias("ks")),
    "q_format": _format,
    "q_normalise": _normalise,
    "q_accuracy": _accuracy,
    "q_answer_votes": _votes,
    "q_content_parts": _parts,
    "q_training_prompts": _train_prompts,
    "q_validation_prompts": _val_prompts,
    "q_paths": _paths,
    "q_overlong": _overlong,
    "q_resize": _resize,
    "q_warmup": _warmup,
    "q_retention": _retention,
    "q_metric_line": _metric_line,
    "q_overlong_tokens": _overlong_tokens,
}

_TOK = "(SELECT value / 97 AS r, CAST(props->>'$.k' AS DOUBLE) / 103 AS v, CAST(event_type <> 'error' AS DOUBLE) AS mask FROM events)"
_SPACE = r"[\s\v\p{Z}\x1c-\x1f\x{85}]*"

SQL = {
    "q_reduce_metrics": f"WITH {TRAJ} SELECT round(avg(acc), 6) AS acc, round(avg(mar), 6) AS mar, round(avg(len), 6) AS len FROM traj",
    "q_masked_mean": f"SELECT round(sum(r * mask) / (sum(mask) + 1e-8), 6) AS mean FROM {_TOK}",
    "q_masked_var": f"WITH m AS (SELECT sum(r * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM {_TOK}) SELECT round(sum((r - mean) * (r - mean) * mask) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1), 6) AS var FROM {_TOK}, m",
    "q_length_metrics": "SELECT " + ", ".join(f"round(avg(length({c})), 6) AS {k}_length_mean, max(length({c}))::INT AS {k}_length_max, min(length({c}))::INT AS {k}_length_min, round(avg(CAST(length({c}) = {cap} AS DOUBLE)), 6) AS {k}_length_clip_ratio" for k, c, cap in (("prompt", "role", 9), ("response", "text", 200))) + " FROM conversations",
    "q_data_metrics": f"""
WITH a AS (SELECT value / 97 AS score, value / 89 AS reward FROM events), t AS (SELECT *, r + v AS ret FROM {_TOK} WHERE mask > 0)
SELECT * FROM (SELECT {", ".join(f"round(avg({c}), 6) AS {c}_mean, round(max({c}), 6) AS {c}_max, round(min({c}), 6) AS {c}_min" for c in ("score", "reward"))} FROM a),
 (SELECT {", ".join(f"round(avg({c}), 6) AS {k}_mean, round(max({c}), 6) AS {k}_max, round(min({c}), 6) AS {k}_min" for k, c in (("advantages", "r"), ("returns", "ret"), ("values", "v")))},
         round(1 - var_samp(ret - v) / (var_samp(ret) + 1e-5), 6) AS vf_explained_var FROM t)""",
    "q_timing": f"""
WITH e AS (SELECT ['{"', '".join(_SECTIONS)}'][user_id % 9 + 1] AS section, value, event_type, CAST(props->>'$.k' AS DOUBLE) AS k FROM events),
n AS (SELECT sum(k) FILTER (event_type = 'purchase') AS answered, sum(k) AS every FROM e)
SELECT section, round(sum(value), 6) AS seconds, round(sum(value) * 1000 / any_value(CASE WHEN section IN ('gen', 'reward') THEN answered ELSE every END), 6) AS ms_per_token FROM e, n WHERE section <> 'save' GROUP BY section""",
    "q_flops": "SELECT 6.0::DOUBLE * 3e9 * sum(n_chars) + 12.0::DOUBLE * 36 * 16 * 128 * sum(n_chars::DOUBLE * n_chars) AS flops, sum(n_chars) / (12.5::DOUBLE * 8) AS throughput FROM documents",
    "q_validation": "WITH e AS (SELECT event_type, avg(value) AS s FROM events GROUP BY 1) SELECT event_type, round(s, 6) AS score, round(avg(s) OVER (), 6) AS all_sets FROM e",
    "q_best_scores": "WITH e AS (SELECT event_type AS val_name, event_id, floor(value)::DOUBLE AS s FROM events), m AS (SELECT val_name, max(s) AS best_score FROM e GROUP BY 1) SELECT val_name, best_score, min(event_id) AS best_step FROM e JOIN m USING (val_name) WHERE s = best_score GROUP BY 1, 2",
    "q_batch_means": f"WITH {TRAJ}, b AS (SELECT avg(len) AS l FROM traj GROUP BY uid) SELECT round(avg(l), 6) AS len FROM b",
    "q_append_values": "SELECT user_id, string_agg(props->>'$.k', ',' ORDER BY event_id) AS ks FROM events GROUP BY user_id",
    "q_format": r"""WITH r AS (SELECT conv_id, turn, '<think>' || text || '</think> ' || CASE WHEN turn % 3 = 0 THEN 'none' ELSE '\boxed{7}' || chr(10) END AS response FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CAST(regexp_full_match(response, '(?s)<think>.*</think>.*\\boxed\{.*\}.*') AS DOUBLE) AS format, length(response)::INT AS chars FROM r""",
    "q_normalise": f"SELECT conv_id, turn, regexp_replace(' < think >' || chr(9) || text || chr(10) || '< / think > x / y', '{_SPACE}(<|>|/){_SPACE}', '\\1', 'g') AS response FROM conversations",
    "q_accuracy": """
WITH c AS (SELECT conv_id, turn, length(text) % 5 + 1 AS c, conv_id % 3 + 2 AS m, CAST(length(text) % 3 = 0 AS INT) AS e, (conv_id + turn) % 4 AS kind, length(text) AS n FROM conversations)
SELECT conv_id, turn, CAST(CASE kind WHEN 0 THEN c + m + e = c + m WHEN 1 THEN n = n + e WHEN 2 THEN c + m = c + m + e ELSE false END AS DOUBLE) AS accuracy FROM c""",
    "q_answer_votes": "WITH v AS (SELECT conv_id, length(text) % 4 AS half, count(*) AS n FROM conversations GROUP BY ALL) SELECT conv_id, count(*) AS answers, max(n) AS votes FROM v GROUP BY conv_id",
    "q_content_parts": """WITH c AS (SELECT conv_id, turn, '<image>' || text || CASE WHEN turn = 0 THEN '<image>?' ELSE '' END AS p FROM conversations WHERE role = 'user'),
s AS (SELECT conv_id, turn, string_split(trim(p) || ' Reason.', '<image>') AS x FROM c),
u AS (SELECT conv_id, turn, unnest(x) AS piece, generate_subscripts(x, 1) AS i FROM s)
SELECT conv_id, turn, array_to_string(list_filter(flatten(list([CASE WHEN i > 1 THEN 'image=' END, CASE WHEN piece <> '' THEN 'text=' || piece END] ORDER BY i)), lambda y: y IS NOT NULL), '|') AS parts FROM u GROUP BY 1, 2""",
    "q_training_prompts": "WITH c AS (SELECT CASE WHEN turn = 0 THEN '<image>' || chr(10) || text ELSE text END AS q, conv_id::VARCHAR AS qid FROM conversations WHERE role = 'user') SELECT CASE WHEN contains(q, '<image>') THEN q ELSE '<image>' || chr(10) || q END AS question, qid, NOT contains(q, '<image>') AS lacked_marker FROM c",
    "q_validation_prompts": r"""SELECT p_partkey, '<image>' || chr(10) || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'A. ' || p_type || chr(10) || 'B. ' || p_brand || chr(10) || 'C. ' || p_name ELSE '' END AS question, '\boxed{' || p_brand || '}' AS answer FROM part""",
    "q_paths": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '/abs/' ELSE '/data/' END || p_name AS path FROM part",
    "q_overlong": r"WITH t AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::INT AS n_tokens FROM conversations) SELECT * FROM t WHERE n_tokens <= 20",
    "q_resize": """WITH p AS (SELECT p_partkey, p_size * 61 + 13 AS w, p_partkey % 997 + 5 AS h FROM part),
a AS (SELECT p_partkey, CASE WHEN w::DOUBLE * h > 600000 THEN floor(w * sqrt(600000 / (w::DOUBLE * h))) ELSE w END AS w, CASE WHEN w::DOUBLE * h > 600000 THEN floor(h * sqrt(600000 / (w::DOUBLE * h))) ELSE h END AS h FROM p)
SELECT p_partkey, (CASE WHEN w * h < 40000 THEN floor(w * sqrt(40000 / (w * h))) ELSE w END)::BIGINT AS w, (CASE WHEN w * h < 40000 THEN floor(h * sqrt(40000 / (w * h))) ELSE h END)::BIGINT AS h FROM a""",
    "q_warmup": "SELECT c_custkey, least(1, c_custkey / 64.0::DOUBLE) AS rate, ceil(c_custkey / 7)::BIGINT AS parts FROM customer",
    "q_retention": "SELECT * FROM (VALUES ('/ck/global_step_0', 0::BIGINT), ('/ck/global_step_20', 20::BIGINT)) t(path, step)",
    "q_metric_line": """SELECT '{"step":3,"val":{"top":' || max(r_regionkey) || ',"low":' || min(r_regionkey) || '},"rows":' || count(*) || '}' AS line FROM region""",
}
