"""Token sequences: masks, padding, scans, divergence, objectives. Arrays here, windows in the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays
from ..functions.scalar import grid_positions_udf
from ..operators import advantage, kl, loss, scan
from ..operators.batch import explode_tokens, spread
from .views import TOKENS, events, rounded, sequences, table, tokens


def _long(df, *columns, digits=6):
    """Arrays of df in long form, rounded."""
    flat = df.select("row_id", F.posexplode(F.arrays_zip(*columns)).alias("pos", "x"))
    return rounded(flat.select("row_id", F.col("pos").cast("long").alias("pos"), *[F.col(f"x.{c}").alias(c) for c in columns]), "row_id", "pos", *columns, digits=digits)


def _gae(spark, d):
    return _long(advantage.advantage("gae", sequences(spark, d), gamma=0.9, lam=0.95), "advantages", "returns")


def _reinforce(spark, d):
    return _long(advantage.advantage("reinforce_plus_plus", sequences(spark, d), gamma=0.97), "advantages", "returns")


def _gae_tokens(spark, d):
    """The same estimate from tokens in long form, in blocks of 16 positions."""
    rows = scan.gae_tokens(tokens(spark, d), reward="r", value="v", gamma=0.9, lam=0.95, block=16)
    return rounded(rows.withColumn("pos", F.col("pos").cast("long")), "row_id", "pos", "advantages", "returns")


def _reinforce_tokens(spark, d):
    rows = scan.reinforce_plus_plus_tokens(tokens(spark, d), reward="r", gamma=0.97, block=16)
    return rounded(rows.withColumn("pos", F.col("pos").cast("long")), "row_id", "pos", "advantages", "returns")


def _reset(spark, d):
    """Discounted values that begin anew after each error, forwards over all events as one sequence."""
    e = events(spark, d).select(F.lit(0).alias("run"), "event_id", (F.col("value") / 97).alias("x"), (F.col("event_type") != "error").cast("double").alias("go"))
    return rounded(scan.linear_recurrence(e, "run", "event_id", "x", 0.53 * F.col("go"), "y"), "event_id", "y")


def _ids(spark, d):
    """A row a user: token ids k, with eos 7."""
    items = F.sort_array(F.collect_list(F.struct("event_id", F.col("k").cast("long").alias("k"))))
    return events(spark, d).groupBy(F.col("user_id").alias("row_id")).agg(F.transform(items, lambda x: x["k"]).alias("ids"))


def _mask(spark, d):
    rows = _ids(spark, d).withColumn("mask", arrays.eos_mask(F.col("ids"), 7))
    return rows.select("row_id", F.posexplode("mask").alias("pos", "mask")).select("row_id", F.col("pos").cast("long").alias("pos"), "mask")


def _each(rows, made: dict):
    """Arrays in long form: which, row_id, pos, value. All are made of a row at once, so rows are read once however many there are."""
    each = rows.select("row_id", F.inline(F.array(*[F.struct(F.lit(name).alias("which"), values.alias("values")) for name, values in made.items()])))
    return each.select("which", "row_id", F.posexplode("values").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def _shape(spark, d):
    ids = F.col("ids")
    made = {"right": arrays.truncate(ids, 20), "left": arrays.truncate(ids, 20, "left"), "safe": arrays.truncate(ids, 10_000, "error"), "padded": arrays.pad(arrays.truncate(ids, 20), 25, -1), "padded_left": arrays.pad(ids, 120, -2, left=True), "prefix": arrays.valid_prefix(ids, F.lit(3))}
    return _each(_ids(spark, d), made)


def _positions(spark, d):
    rows = _ids(spark, d).withColumn("mask", F.transform("ids", lambda x: (x > 20).cast("int")))
    rows = rows.withColumn("positions", arrays.position_ids(F.col("mask")))
    return _each(rows, {"own": F.col("positions"), "next": arrays.continue_positions(F.col("positions"), F.lit(4))})


def _segments(spark, d):
    rows = _ids(spark, d).withColumn("positions", F.transform("ids", lambda x, i: i % 30))
    return _each(rows, {"length": arrays.segment_lengths(F.col("positions"))}).drop("which")


def _shifted(spark, d):
    return _each(_ids(spark, d), {"label": arrays.shifted(F.col("ids"), -100)}).drop("which")


def _kl_rows(kind):
    def run(spark, d):
        t = tokens(spark, d)
        return rounded(t.select("row_id", F.col("pos").cast("long").alias("pos"), kl.kl_term(F.col("lp"), F.col("ref"), kind).alias("kl")), "row_id", "pos", "kl")

    return run


def _full_kl(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double")).alias("p"), F.transform(F.slice("embedding", 33, 32), lambda x: x.cast("double")).alias("q"))
    return rounded(rows.select("vec_id", kl.kl_term(F.col("p"), F.col("q"), "full").alias("kl")), "vec_id", "kl")


def _log_softmax(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), "label")
    return rounded(rows.select("vec_id", arrays.log_softmax_at(F.col("x"), F.col("label")).alias("lp")), "vec_id", "lp")


def _penalty(spark, d):
    rows, _ = kl.apply_kl_penalty(sequences(spark, d).withColumn("scores", F.col("rewards")).drop("rewards"), kl.controller("fixed", 0.05), "low_var_kl")
    return _long(rows, "rewards")


def _penalty_metrics(spark, d):
    rows = sequences(spark, d).withColumn("scores", F.col("rewards")).drop("rewards")
    return rounded(kl.apply_kl_penalty(rows, kl.controller("fixed", 0.05), "kl")[1], "kl", "kl_coef", "rows")


def _objective(spark, d):
    t = tokens(spark, d).where("mask > 0")
    return t.select("row_id", F.col("lp").alias("old"), (F.col("ref") * 1.1).alias("new"), (F.col("v") - 0.4).alias("adv"), F.col("v").alias("pred"), (F.col("v") * 0.9).alias("values"), F.col("r").alias("returns"))


def _policy(mode):
    return lambda spark, d: rounded(loss.policy_loss(_objective(spark, d), mode), "pg_loss", "pg_clipfrac_higher", "pg_clipfrac_lower", "ppo_kl", "entropy_loss")


def _value(mode):
    return lambda spark, d: rounded(loss.value_loss(_objective(spark, d), 0.05, mode), "vf_loss", "vf_clipfrac", "vpred_mean")


def _terms(spark, d):
    return rounded(loss.policy_terms(tokens(spark, d).select("row_id", "pos", F.col("lp").alias("old"), F.col("ref").alias("new"), (F.col("v") - 0.4).alias("adv"))).withColumn("pos", F.col("pos").cast("long")), "row_id", "pos", "token_loss", "clipped_high", "clipped_low", "neg_kl")


def _scaled(spark, d):
    rows = tokens(spark, d).groupBy("row_id").agg(F.avg("r").alias("pg"), F.avg("v").alias("kl"), F.sum("mask").alias("n"))
    return rounded(rows.select("row_id", loss.scaled_loss(F.col("pg"), F.col("kl"), 0.02, F.col("n"), 4, F.lit(1000.0)).alias("loss"), loss.finite(F.col("pg")).alias("finite")), "row_id", "loss", "finite")


def _grid(apart):
    def run(spark, d):
        """For each customer: text, an image, text, a video, text; the shapes follow the key."""
        k = F.col("c_custkey")
        some = lambda n, x: F.array_repeat(F.lit(x), n.cast("int"))
        grid = lambda t, h, w: F.array(F.array(t.cast("int"), (2 * h).cast("int"), (2 * w).cast("int")))
        t, h, w, one = k % 3 + 1, k % 4 + 1, k % 2 + 1, F.lit(1)
        # With frames apart a token of text stands before each frame.
        film = F.flatten(F.array_repeat(F.concat(some(one, 1), some(F.lit(2), 8)), t.cast("int"))) if apart else some(2 * t, 8)
        rows = spread(table(spark, d, "customer").select("c_custkey"), "c_custkey").select(k.alias("row_id"), F.concat(some(k % 5 + 1, 1), some(h * w, 9), some(k % 4 + 1, 1), film, some(k % 2 + 1, 1)).alias("ids"), grid(one, h, w).alias("images"), grid(t, one, 2 * one).alias("videos"), F.array(F.lit(1.5)).alias("seconds"))
        rows = rows.select("row_id", grid_positions_udf(9, 8, frames_apart=apart)("ids", "images", "videos", "seconds").alias("p"))
        return rows.select("row_id", F.posexplode("p").alias("pos", "c")).select("row_id", F.col("pos").cast("long").alias("pos"), "c.time", "c.height", "c.width")

    return run


QUERIES = {
    "q_gae": _gae,
    "q_reinforce_pp": _reinforce,
    "q_gae_tokens": _gae_tokens,
    "q_reinforce_pp_tokens": _reinforce_tokens,
    "q_scan_reset": _reset,
    "q_eos_mask": _mask,
    "q_pad_truncate": _shape,
    "q_position_ids": _positions,
    "q_segments": _segments,
    "q_shifted_labels": _shifted,
    "q_masked_select": lambda spark, d: rounded(explode_tokens(sequences(spark, d), "rewards", "mask").withColumn("pos", F.col("pos").cast("long")), "row_id", "pos", "rewards"),
    "q_masked_row_mean": lambda spark, d: rounded(sequences(spark, d).select("row_id", arrays.masked_row_mean(F.col("rewards"), F.col("mask")).alias("mean"), arrays.total(F.col("rewards")).alias("total")), "row_id", "mean", "total"),
    "q_kl": _kl_rows("kl"),
    "q_kl_abs": _kl_rows("abs"),
    "q_kl_mse": _kl_rows("mse"),
    "q_kl_low_var": _kl_rows("low_var_kl"),
    "q_kl_full": _full_kl,
    "q_log_softmax": _log_softmax,
    "q_kl_penalty": _penalty,
    "q_kl_penalty_metrics": _penalty_metrics,
    "q_policy_terms": _terms,
    "q_policy_loss": _policy("token"),
    "q_policy_loss_seq": _policy("seq"),
    "q_value_loss": _value("token"),
    "q_value_loss_seq": _value("seq"),
    "q_scaled_loss": _scaled,
    "q_grid_positions": _grid(False),
    "q_grid_frames": _grid(True),
    "q_has_token": lambda spark, d: _ids(spark, d).select("row_id", arrays.has_token(F.col("ids"), 13).alias("has")),
}

_IDS = "ids AS (SELECT user_id AS row_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n, CAST(props->>'$.k' AS BIGINT) AS k FROM events)"
_D = "lp - ref"
_LOW = f"greatest(-20, least(20, -({_D})))"


def _kl_sql(expr):
    return f"WITH {TOKENS} SELECT row_id, pos, round({expr}, 6) + 0.0 AS kl FROM tokens"


_OBJ = f"""{TOKENS}, o AS (
  SELECT row_id, lp AS old, ref * 1.1::DOUBLE AS new, v - 0.4::DOUBLE AS adv, v AS pred, v * 0.9::DOUBLE AS vals, r AS ret FROM tokens WHERE mask > 0
), x AS (
  SELECT *, greatest(-20, least(20, new - old)) AS dx, greatest(vals - 0.05, least(vals + 0.05, pred)) AS near FROM o
), y AS (
  SELECT *, -adv * exp(dx) AS free, -adv * exp(greatest(ln(0.8), least(ln(1.3), dx))) AS cl, pow(pred - ret, 2) AS vfree, pow(near - ret, 2) AS vheld FROM x
), z AS (
  SELECT *, CASE WHEN adv < 0 THEN least(greatest(free, cl), -adv * 3) ELSE greatest(free, cl) END AS loss, CAST(free < cl AS DOUBLE) AS high,
         CASE WHEN adv < 0 THEN CAST(greatest(free, cl) > -adv * 3 AS DOUBLE) ELSE 0 END AS low FROM y)"""

#: first, mid: tokens of text before and after the image of h x w cells; film: the position after these.
_SHAPES = """c AS (
  SELECT *, first + greatest(h, w) + mid AS film FROM (
    SELECT c_custkey AS k, c_custkey % 5 + 1 AS first, c_custkey % 4 + 1 AS mid, c_custkey % 4 + 1 AS h, c_custkey % 2 + 1 AS w, c_custkey % 3 + 1 AS t FROM customer))"""
_HEAD = """SELECT k AS row_id, i::BIGINT AS pos, i::BIGINT AS "time", i::BIGINT AS height, i::BIGINT AS width FROM c, generate_series(0, 4) AS g(i) WHERE i < first
UNION ALL SELECT k, first + i, first, first + i // w, first + i % w FROM c, generate_series(0, 7) AS g(i) WHERE i < h * w
UNION ALL SELECT k, first + h * w + i, first + greatest(h, w) + i, first + greatest(h, w) + i, first + greatest(h, w) + i FROM c, generate_series(0, 3) AS g(i) WHERE i < mid"""

SQL = {
    "q_gae": f"""
WITH {TOKENS}, a AS (SELECT *, r + 0.9 * coalesce(lead(v) OVER (PARTITION BY row_id ORDER BY pos), 0) - v AS delta FROM tokens),
b AS (SELECT *, sum(delta * pow(0.855, pos)) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.855, pos) AS adv FROM a),
m AS (SELECT sum(adv) / (count(*) + 1e-8) AS mean, count(*) AS n FROM b),
s AS (SELECT sum((adv - mean) * (adv - mean)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM b, m)
SELECT row_id, pos, round((adv - mean) / sqrt(var + 1e-8), 6) + 0.0 AS advantages, round(adv + v, 6) + 0.0 AS returns FROM b, m, s""",
    "q_reinforce_pp": f"""
WITH {TOKENS}, b AS (SELECT *, sum(r * pow(0.97, pos)) OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.97, pos) AS ret FROM tokens),
m AS (SELECT sum(ret) / (count(*) + 1e-8) AS mean, count(*) AS n FROM b),
s AS (SELECT sum((ret - mean) * (ret - mean)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM b, m)
SELECT row_id, pos, round((ret - mean) / sqrt(var + 1e-8), 6) + 0.0 AS advantages, round(ret, 6) + 0.0 AS returns FROM b, m, s""",
    "q_eos_mask": f"WITH {_IDS} SELECT row_id, pos, CAST(sum(CAST(k = 7 AS INT)) OVER (PARTITION BY row_id ORDER BY pos) - CAST(k = 7 AS INT) = 0 AS INT) AS mask FROM ids",
    "q_pad_truncate": f"""
WITH {_IDS} SELECT 'right' AS which, row_id, pos, k AS value FROM ids WHERE pos < 20
UNION ALL SELECT 'left', row_id, pos - greatest(n - 20, 0), k FROM ids WHERE pos >= n - 20
UNION ALL SELECT 'safe', row_id, pos, k FROM ids
UNION ALL SELECT 'padded', row_id, pos, k FROM ids WHERE pos < 20
UNION ALL SELECT 'padded', row_id, g.i, -1 FROM (SELECT row_id, least(20, any_value(n)) AS n FROM ids GROUP BY row_id), generate_series(0, 24) AS g(i) WHERE g.i >= n
UNION ALL SELECT 'padded_left', row_id, pos + greatest(120 - n, 0), k FROM ids
UNION ALL SELECT 'padded_left', row_id, g.i, -2 FROM (SELECT row_id, any_value(n) AS n FROM ids GROUP BY row_id), generate_series(0, 119) AS g(i) WHERE g.i < 120 - n
UNION ALL SELECT 'prefix', row_id, pos, k FROM ids WHERE pos < 3""",
    "q_position_ids": f"""
WITH {_IDS}, p AS (SELECT *, greatest(0, sum(CAST(k > 20 AS INT)) OVER (PARTITION BY row_id ORDER BY pos) - 1)::BIGINT AS position FROM ids)
SELECT 'own' AS which, row_id, pos, position AS value FROM p
UNION ALL SELECT 'next', row_id, g.i - 1, position + g.i FROM p, generate_series(1, 4) AS g(i) WHERE pos = n - 1""",
    "q_segments": f"WITH {_IDS} SELECT row_id, pos // 30 AS pos, count(*)::INT AS value FROM ids GROUP BY ALL",
    "q_shifted_labels": f"WITH {_IDS} SELECT row_id, pos, coalesce(lead(k) OVER (PARTITION BY row_id ORDER BY pos), -100) AS value FROM ids",
    "q_has_token": f"WITH {_IDS} SELECT row_id, bool_or(k = 13) AS has FROM ids GROUP BY row_id",
    "q_masked_select": f"WITH {TOKENS} SELECT row_id, pos, round(r, 6) + 0.0 AS rewards FROM tokens WHERE mask > 0",
    "q_masked_row_mean": f"WITH {TOKENS} SELECT row_id, round(sum(r * mask) / (sum(mask) + 1e-8), 6) + 0.0 AS mean, round(sum(r), 6) + 0.0 AS total FROM tokens GROUP BY row_id",
    "q_kl": _kl_sql(_D),
    "q_kl_abs": _kl_sql(f"abs({_D})"),
    "q_kl_mse": _kl_sql(f"0.5 * ({_D}) * ({_D})"),
    "q_kl_low_var": _kl_sql(f"greatest(-10, least(10, exp({_LOW}) - ({_LOW}) - 1))"),
    "q_kl_full": "WITH e AS (SELECT vec_id, unnest(embedding[1:32])::DOUBLE AS p, unnest(embedding[33:64])::DOUBLE AS q FROM embeddings) SELECT vec_id, round(sum(exp(q) * (q - p)), 6) + 0.0 AS kl FROM e GROUP BY vec_id",
    "q_log_softmax": "WITH e AS (SELECT vec_id, embedding[label + 1]::DOUBLE AS x, unnest(embedding)::DOUBLE AS y FROM embeddings) SELECT vec_id, round(any_value(x) - ln(sum(exp(y))), 6) + 0.0 AS lp FROM e GROUP BY vec_id",
    "q_kl_penalty": f"WITH {TOKENS} SELECT row_id, pos, round(r - 0.05 * mask * greatest(-10, least(10, exp({_LOW}) - ({_LOW}) - 1)), 6) + 0.0 AS rewards FROM tokens",
    "q_kl_penalty_metrics": f"WITH {TOKENS}, m AS (SELECT row_id, sum(({_D}) * mask * mask) / (sum(mask) + 1e-8) AS k FROM tokens GROUP BY row_id) SELECT round(avg(k), 6) + 0.0 AS kl, 0.05::DOUBLE AS kl_coef, count(*) AS rows FROM m",
    "q_policy_terms": f"""
WITH {TOKENS}, x AS (SELECT row_id, pos, v - 0.4::DOUBLE AS adv, greatest(-20, least(20, ref - lp)) AS dx FROM tokens),
y AS (SELECT *, -adv * exp(dx) AS free, -adv * exp(greatest(ln(0.8), least(ln(1.3), dx))) AS cl FROM x)
SELECT row_id, pos, round(CASE WHEN adv < 0 THEN least(greatest(free, cl), -adv * 3) ELSE greatest(free, cl) END, 6) + 0.0 AS token_loss,
       CAST(free < cl AS DOUBLE) AS clipped_high, CASE WHEN adv < 0 THEN CAST(greatest(free, cl) > -adv * 3 AS DOUBLE) ELSE 0 END AS clipped_low, round(-dx, 6) + 0.0 AS neg_kl FROM y""",
    "q_policy_loss": f"WITH {_OBJ} SELECT round(sum(loss) / (count(*) + 1e-8), 6) + 0.0 AS pg_loss, round(sum(high) / (count(*) + 1e-8), 6) AS pg_clipfrac_higher, round(sum(low) / (count(*) + 1e-8), 6) AS pg_clipfrac_lower, round(sum(-dx) / (count(*) + 1e-8), 6) + 0.0 AS ppo_kl, round(sum(-new) / (count(*) + 1e-8), 6) + 0.0 AS entropy_loss FROM z",
    "q_policy_loss_seq": f"WITH {_OBJ}, q AS (SELECT sum(loss) / (count(*) + 1e-8) AS l, sum(-new) / (count(*) + 1e-8) AS e, sum(high) AS h, sum(low) AS w, sum(-dx) AS k, count(*) AS n FROM z GROUP BY row_id) SELECT round(avg(l), 6) + 0.0 AS pg_loss, round(sum(h) / (sum(n) + 1e-8), 6) AS pg_clipfrac_higher, round(sum(w) / (sum(n) + 1e-8), 6) AS pg_clipfrac_lower, round(sum(k) / (sum(n) + 1e-8), 6) + 0.0 AS ppo_kl, round(avg(e), 6) + 0.0 AS entropy_loss FROM q",
    "q_value_loss": f"WITH {_OBJ} SELECT round(0.5 * sum(greatest(vfree, vheld)) / (count(*) + 1e-8), 6) AS vf_loss, round(sum(CAST(vfree < vheld AS DOUBLE)) / (count(*) + 1e-8), 6) AS vf_clipfrac, round(sum(pred) / (count(*) + 1e-8), 6) AS vpred_mean FROM z",
    "q_value_loss_seq": f"WITH {_OBJ}, q AS (SELECT sum(greatest(vfree, vheld)) / (count(*) + 1e-8) AS l, sum(CAST(vfree < vheld AS DOUBLE)) AS c, sum(pred) AS p, count(*) AS n FROM z GROUP BY row_id) SELECT round(0.5 * avg(l), 6) AS vf_loss, round(sum(c) / (sum(n) + 1e-8), 6) AS vf_clipfrac, round(sum(p) / (sum(n) + 1e-8), 6) AS vpred_mean FROM q",
    "q_scaled_loss": f"WITH {TOKENS} SELECT row_id, round((avg(r) + 0.02 * avg(v)) * sum(mask) * 4 / 1000, 6) + 0.0 AS loss, true AS finite FROM tokens GROUP BY row_id",
    "q_grid_positions": f"""
WITH {_SHAPES}, tail AS (SELECT *, film + greatest(3 * (t - 1), 1) + 1 AS rest, first + h * w + mid AS seen FROM c)
{_HEAD}
UNION ALL SELECT k, seen + i, film + 3 * (i // 2), film, film + i % 2 FROM tail, generate_series(0, 5) AS g(i) WHERE i < 2 * t
UNION ALL SELECT k, seen + 2 * t + i, rest + i, rest + i, rest + i FROM tail, generate_series(0, 1) AS g(i) WHERE i < k % 2 + 1""",
    "q_grid_frames": f"""
WITH {_SHAPES}, tail AS (SELECT *, film + 3 * t AS rest, first + h * w + mid AS seen FROM c)
{_HEAD}
UNION ALL SELECT k, seen + 3 * j, film + 3 * j, film + 3 * j, film + 3 * j FROM tail, generate_series(0, 2) AS g(j) WHERE j < t
UNION ALL SELECT k, seen + 3 * j + 1 + i, film + 3 * j + 1, film + 3 * j + 1, film + 3 * j + 1 + i FROM tail, generate_series(0, 2) AS g(j), generate_series(0, 1) AS e(i) WHERE j < t
UNION ALL SELECT k, seen + 3 * t + i, rest + i, rest + i, rest + i FROM tail, generate_series(0, 1) AS g(i) WHERE i < k % 2 + 1""",
}
SQL["q_gae_tokens"] = SQL["q_gae"]
SQL["q_reinforce_pp_tokens"] = SQL["q_reinforce_pp"]
#: What is 60 steps back has a weight below 1e-16. The factor is no power of two, which with these values gives rounding ties.
SQL["q_scan_reset"] = """
WITH e AS (SELECT event_id, value / 97 AS x, sum(CAST(event_type = 'error' AS INT)) OVER (ORDER BY event_id) AS run FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY event_id) AS i FROM e)
SELECT a.event_id, round(sum(b.x * pow(0.53::DOUBLE, a.i - b.i)), 6) + 0.0 AS y FROM p a JOIN p b ON a.run = b.run AND b.i <= a.i AND b.i > a.i - 60 GROUP BY a.event_id"""
