"""Rewards, curriculum, group advantages, attention ratios, group coefficients."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advantage, curriculum, kl, mar, rewards
from .training import training_step
from .views import ATTN, TRAJ, attention, events, rounded, sequences, table, trajectories

REWARD_COLUMNS = ("row_id", "overall", "acc", "fmt", "r_len", "r_perc", "mar", "mar_available", "difficulty")
SCHEDULE = [{"epoch_ratio": 0.5, "filter_low": 0.01, "filter_high": 0.7}, {"epoch_ratio": 1.0, "filter_low": 0.3, "filter_high": 0.99}]
PAIRS = [(0, 1), (1, 3), (2, 0), (2, 2), (3, 1)]


def _reward(rule, columns=REWARD_COLUMNS):
    return lambda spark, d: rounded(rule(trajectories(spark, d)), *columns)


def _traj_without_mar(spark, d):
    return trajectories(spark, d).withColumn("mar", F.when(F.col("row_id") % 3 != 0, F.col("mar")))


def _thinking(spark, d):
    t = trajectories(spark, d).withColumn("complexity", F.when(F.col("uid") % 7 != 0, F.col("mar")))
    return rounded(rewards.thinking_reward(t), "row_id", "overall", "fmt", "acc", "difficulty", "len_score")


def _grpo(spark, d):
    return rounded(advantage.grpo(events(spark, d).withColumnRenamed("value", "score"), group="user_id"), "event_id", "advantage")


def _rloo(spark, d):
    return rounded(advantage.rloo(events(spark, d).withColumnRenamed("value", "score"), group="user_id"), "event_id", "advantage")


def _remax(spark, d):
    rows = sequences(spark, d).withColumn("reward_baseline", F.col("row_id") / 7.0)
    return rounded(advantage.advantage("remax", rows), "row_id", "advantage")


def _schedule(spark, d):
    points = spark.createDataFrame([(p["epoch_ratio"], p["filter_low"], p["filter_high"]) for p in SCHEDULE], "epoch_ratio double, filter_low double, filter_high double")
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") / 1000.0).alias("progress"))
    return curriculum.schedule_lookup(rows, "progress", points).select("c_custkey", "filter_low", "filter_high")


def _ceiling(spark, d):
    t = trajectories(spark, d).withColumn("h_perc", F.col("mar"))
    return curriculum.perception_ceiling(t, 0.5).select("row_id")


def _ratio(mode):
    def run(spark, d):
        a = attention(spark, d)
        return rounded(mar.ratios(table(spark, d, "embeddings").select(F.col("vec_id").alias("sample")), a, mode, 4, 4, 4, PAIRS), "sample", "mar")

    return run


def _group_kl(spark, d):
    return rounded(kl.group_accuracy_coefficients(trajectories(spark, d), 0.001, 0.1, 8), "row_id", "kl_coef")


def _perception_kl(spark, d):
    t = trajectories(spark, d).withColumns({"h_perc": F.col("mar"), "h_ans": F.col("len") / 9973.0})
    return rounded(kl.perception_coefficients(t, 0.001, 0.1, 0.6, 8), "row_id", "kl_coef")


QUERIES = {
    "q_training_step": lambda spark, d: rounded(training_step(trajectories(spark, d), 0.05, 0.6, 40), "rows", "overall_mean", "acc_mean", "r_len_mean", "r_perc_mean", "difficulty_mean", "advantage_max", "advantage_min", digits=4),
    "q_reward_grouped": _reward(rewards.grouped_reward, (*REWARD_COLUMNS, "state")),
    "q_reward_missing_mar": lambda spark, d: rounded(rewards.grouped_reward(_traj_without_mar(spark, d)), *REWARD_COLUMNS, "state"),
    "q_reward_perception": _reward(rewards.perception_reward),
    "q_reward_answer_length": _reward(rewards.answer_length_reward),
    "q_reward_answer_perception": _reward(rewards.answer_perception_reward),
    "q_reward_answer": _reward(rewards.answer_reward),
    "q_reward_baseline": _reward(rewards.baseline_reward),
    "q_reward_batch": _reward(rewards.batch_reward, (*REWARD_COLUMNS, "state")),
    "q_reward_thinking": _thinking,
    "q_group_band": lambda spark, d: curriculum.group_band(trajectories(spark, d), 0.2, 0.3, "user").select("row_id", "user"),
    "q_limit_groups": lambda spark, d: curriculum.make_batch(trajectories(spark, d), 20, 0.05, 0.6).select("row_id", "uid"),
    "q_schedule": _schedule,
    "q_perception_ceiling": _ceiling,
    "q_grpo": _grpo,
    "q_rloo": _rloo,
    "q_remax": _remax,
    "q_mar_mid": _ratio("mid"),
    "q_mar_topk": _ratio("full_topk"),
    "q_mar_heads": _ratio("vsh"),
    "q_mar_disabled": _ratio("disabled"),
    "q_mar_summary": lambda spark, d: rounded(mar.summary(_ratio("full_topk")(spark, d).withColumn("mar", F.when(F.col("sample") % 4 > 0, F.col("mar")).otherwise(0.0))), "total", "nonzero", "mean", "max"),
    "q_kl_group": _group_kl,
    "q_kl_perception": _perception_kl,
}


def _grouped_sql(traj="traj", len_weight=0.1, perc_weight=0.1, state=False, prefix=""):
    """SQL of the grouped rule over a relation like traj."""
    use_len, use_perc = float(len_weight != 0), float(perc_weight != 0)
    return f"""
WITH {TRAJ}{prefix}, s AS (
  SELECT *, avg(acc) OVER w AS pass, avg(mar) OVER w - stddev_pop(mar) OVER w AS tau, avg(len) OVER w AS avg_len,
         min(mar) OVER () AS lo, max(mar) OVER () AS hi, max(CAST(mar IS NOT NULL AS INT)) OVER () AS any_mar
  FROM {traj} WINDOW w AS (PARTITION BY uid)
), t AS (
  SELECT *, len / avg_len AS rho, 1 - pass AS d, CASE WHEN hi > lo THEN hi - lo ELSE 1 END AS width,
         CASE WHEN mar > tau AND acc = 1 THEN 'A' WHEN mar > tau AND acc = 0 THEN 'B' WHEN mar <= tau AND acc = 1 THEN 'C' ELSE 'D' END AS state
  FROM s
), u AS (
  SELECT *, {use_len} * CASE state WHEN 'A' THEN greatest(-1, least(1, 1 - rho)) WHEN 'B' THEN d * greatest(0, least(1, rho - 1))
            WHEN 'C' THEN -((1 + d) / 2) * greatest(0, least(1, rho - 1)) ELSE 0 END AS r_len,
         {use_perc} * CASE state WHEN 'A' THEN (mar - lo) / width WHEN 'C' THEN -((tau - lo) / width) ELSE 0 END AS r_perc
  FROM t)
SELECT row_id, round(acc + 0.1 * fmt + {len_weight} * r_len + {perc_weight} * r_perc, 6) + 0.0 AS overall, acc, fmt, round(r_len, 6) + 0.0 AS r_len,
       round(r_perc, 6) + 0.0 AS r_perc, round(mar, 6) AS mar, CAST(any_mar AS DOUBLE) AS mar_available, round(d, 6) AS difficulty{", state" if state else ""}
FROM u"""


def _plain_sql(overall, mar, available):
    return f"WITH {TRAJ} SELECT row_id, round({overall}, 6) AS overall, acc, fmt, 0.0::DOUBLE AS r_len, 0.0::DOUBLE AS r_perc, {mar} AS mar, {available}::DOUBLE AS mar_available, 0.0::DOUBLE AS difficulty FROM traj"


_BAND = "kept AS (SELECT uid FROM traj GROUP BY uid HAVING avg(acc) > 0.05 AND avg(acc) < 0.6), turn AS (SELECT uid, row_number() OVER (ORDER BY min(row_id), uid) AS n FROM traj SEMI JOIN kept USING (uid) GROUP BY uid)"
_CUT = _BAND + ", cut AS (SELECT * FROM traj WHERE uid IN (SELECT uid FROM turn WHERE n <= 40))"

SQL = {
    "q_training_step": f"""
WITH scored AS ({_grouped_sql("cut", prefix=", " + _CUT)}), g AS (
  SELECT *, row_id // 8 AS uid FROM scored
), full_ AS (
  SELECT g.*, (overall - avg(overall) OVER w) / (stddev_samp(overall) OVER w + 1e-6) AS advantage FROM g WINDOW w AS (PARTITION BY uid))
SELECT count(*) AS rows, round(avg(overall), 4) AS overall_mean, round(avg(acc), 4) AS acc_mean, round(avg(r_len), 4) AS r_len_mean,
       round(avg(r_perc), 4) AS r_perc_mean, round(avg(difficulty), 4) AS difficulty_mean, round(max(advantage), 4) AS advantage_max, round(min(advantage), 4) AS advantage_min
FROM full_""",
    "q_reward_grouped": _grouped_sql(state=True),
    "q_reward_missing_mar": _grouped_sql("thin", state=True, prefix=", thin AS (SELECT * REPLACE (CASE WHEN row_id % 3 <> 0 THEN mar END AS mar) FROM traj)"),
    "q_reward_perception": _grouped_sql(perc_weight=0.2),
    "q_reward_answer_length": _grouped_sql(perc_weight=0.0),
    "q_reward_answer_perception": _grouped_sql(len_weight=0.0),
    "q_reward_answer": _plain_sql("acc + 0.1 * fmt", "round(mar, 6)", "(mar IS NOT NULL)"),
    "q_reward_baseline": _plain_sql("acc + 0.1 * fmt - 0.01 * len / 4096", "0.0::DOUBLE", "0.0"),
    "q_reward_batch": f"""
WITH {TRAJ}, s AS (
  SELECT *, avg(mar) OVER () - stddev_pop(mar) OVER () AS tau, min(mar) OVER () AS lo, greatest(max(mar) OVER () - min(mar) OVER (), 1e-8) AS width,
         1 - avg(acc) OVER () AS d, len / 1024 AS rho FROM traj
), t AS (
  SELECT *, CASE WHEN mar > tau AND acc = 1 THEN 'A' WHEN mar > tau AND acc = 0 THEN 'B' WHEN mar <= tau AND acc = 1 THEN 'C' ELSE 'D' END AS state FROM s
), u AS (
  SELECT *, CASE state WHEN 'A' THEN greatest(-1, least(1, 1 - rho)) WHEN 'B' THEN d * greatest(0, least(0.5, rho - 1))
            WHEN 'C' THEN -((1 + d) / 2) * greatest(0, least(1, rho - 1)) ELSE 0 END AS r_len,
         CASE state WHEN 'A' THEN (mar - lo) / width WHEN 'C' THEN -((tau - lo) / width) ELSE 0 END AS r_perc
  FROM t)
SELECT row_id, round(acc + 0.1 * fmt + 0.1 * r_len + 0.1 * r_perc - 0.01 * len / 4096, 6) AS overall, acc, fmt, round(r_len, 6) + 0.0 AS r_len,
       round(r_perc, 6) + 0.0 AS r_perc, round(mar, 6) AS mar, 1.0::DOUBLE AS mar_available, round(d, 6) AS difficulty, state
FROM u""",
    "q_reward_thinking": f"""
WITH {TRAJ}, g AS (
  SELECT uid, sum(acc) / 8 AS pass, coalesce(min_by(CASE WHEN uid % 7 <> 0 THEN mar END, row_id), 0.5) AS first FROM traj GROUP BY uid
), n AS (
  SELECT *, CASE WHEN count(DISTINCT first) OVER () = 1 THEN 0.5 ELSE (rank() OVER (ORDER BY first) - 1 + (count(*) OVER (PARTITION BY first) - 1) / 2.0) / (count(*) OVER () - 1) END AS norm FROM g
), p AS (SELECT *, (1 - pass) * norm AS difficulty FROM n), q AS (SELECT *, difficulty > quantile_cont(difficulty, 0.8) OVER () AS hard FROM p),
t AS (
  SELECT traj.*, difficulty, hard, len / avg(len) OVER () AS rel, count(*) OVER () AS total,
         sum(CAST(NOT hard AND acc = 1 AS INT)) OVER (ORDER BY row_id) AS turn FROM traj JOIN q USING (uid)
), u AS (SELECT *, CASE WHEN NOT hard AND acc = 1 AND turn <= ceil(0.8 * total) THEN 1 - rel WHEN hard AND acc = 0 THEN least(rel - 1, 1) ELSE 0 END AS len_score FROM t)
SELECT row_id, round(acc + 0.5 * fmt + 0.5 * len_score, 6) + 0.0 AS overall, fmt, acc, round(difficulty, 6) AS difficulty, round(len_score, 6) + 0.0 AS len_score FROM u""",
    "q_group_band": f'WITH {TRAJ} SELECT row_id, "user" FROM traj WHERE "user" IN (SELECT "user" FROM traj GROUP BY "user" HAVING avg(acc) > 0.2 AND avg(acc) < 0.3)',
    "q_limit_groups": f"WITH {TRAJ}, {_BAND} SELECT row_id, uid FROM traj WHERE uid IN (SELECT uid FROM turn WHERE n <= 20)",
    "q_schedule": "SELECT c_custkey, CASE WHEN c_custkey / 1000.0 <= 0.5 THEN 0.01::DOUBLE ELSE 0.3::DOUBLE END AS filter_low, CASE WHEN c_custkey / 1000.0 <= 0.5 THEN 0.7::DOUBLE ELSE 0.99::DOUBLE END AS filter_high FROM customer",
    "q_perception_ceiling": f"WITH {TRAJ} SELECT row_id FROM traj WHERE mar <= 0.5",
    "q_grpo": "SELECT event_id, round((value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-6), 6) + 0.0 AS advantage FROM events WINDOW w AS (PARTITION BY user_id)",
    "q_rloo": "SELECT event_id, round(value - (sum(value) OVER w - value) / (count(*) OVER w - 1), 6) + 0.0 AS advantage FROM events WINDOW w AS (PARTITION BY user_id)",
    "q_remax": "SELECT user_id AS row_id, round(sum(value / 97) - user_id / 7.0::DOUBLE, 6) + 0.0 AS advantage FROM events GROUP BY user_id",
    "q_mar_mid": f"WITH {ATTN} SELECT sample, round(sum(vis_mass) / 32.0, 6) AS mar FROM attn WHERE layer >= 1 AND layer < 3 GROUP BY sample",
    "q_mar_topk": f"WITH {ATTN}, p AS (SELECT sample, resp_pos, avg(vis_mass) AS m FROM attn GROUP BY ALL) SELECT sample, round(max(m), 6) AS mar FROM p GROUP BY sample",
    "q_mar_summary": f"WITH {ATTN}, p AS (SELECT sample, resp_pos, avg(vis_mass) AS m FROM attn GROUP BY ALL), r AS (SELECT sample, CASE WHEN sample % 4 > 0 THEN round(max(m), 6) ELSE 0 END AS mar FROM p GROUP BY sample) SELECT count(*) AS total, count(*) FILTER (mar > 0) AS nonzero, round(avg(mar), 6) AS mean, round(max(mar), 6) AS max FROM r",
    "q_mar_heads": f"WITH {ATTN}, p AS (SELECT sample, resp_pos, avg(vis_mass) AS m FROM attn WHERE (layer, head) IN ((0, 1), (1, 3), (2, 0), (2, 2), (3, 1)) GROUP BY ALL) SELECT sample, round(max(m), 6) AS mar FROM p GROUP BY sample",
    "q_mar_disabled": "SELECT vec_id AS sample, 0.0::DOUBLE AS mar FROM embeddings",
    "q_kl_group": f"WITH {TRAJ} SELECT row_id, round(0.001 + 0.099 * (1 - avg(acc) OVER (PARTITION BY row_id // 8)), 6) AS kl_coef FROM traj",
    "q_kl_perception": f"""
WITH {TRAJ}, f AS (SELECT uid, min_by(mar, row_id) AS hp, min_by(len / 9973.0, row_id) AS ha FROM traj GROUP BY uid)
SELECT row_id, round(CASE WHEN hp >= 0.6 THEN 0.1 ELSE 0.001 + 0.099 * (1 - least(ha / 0.25, 1)) END, 6) AS kl_coef FROM traj JOIN f USING (uid)""",
}
