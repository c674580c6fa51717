"""Values worked out by hand from the formulas."""

import math

import pytest
from pyspark.sql import functions as F

from trajectra.functions import arrays, scalar, text
from trajectra.operators import advantage, batch, curriculum, kl, loss, mar, metrics, partition, rewards
from trajectra.sources import prompts, sinks


def close(got, want, tol=1e-6):
    assert len(got) == len(want) and all(math.isclose(a, b, abs_tol=tol) for a, b in zip(got, want)), (got, want)


def test_grouped_reward(spark):
    acc, length = [1, 1, 0, 0, 1, 0, 1, 0], [100, 300, 200, 400, 150, 250, 500, 100]
    sight = [0.30, 0.10, 0.25, 0.05, 0.20, 0.40, 0.22, 0.28]
    df = spark.createDataFrame([(i, "u", float(a), 0.0, m, float(n)) for i, (a, m, n) in enumerate(zip(acc, sight, length))], "row_id long, uid string, acc double, fmt double, mar double, len double")
    rows = rewards.grouped_reward(df).orderBy("row_id").collect()
    assert [r["state"] for r in rows] == list("ACBDABAB")
    close([r["r_len"] for r in rows], [0.6, -0.15, 0, 0, 0.4, 0, -1, 0])
    close([r["r_perc"] for r in rows], [0.714286, -0.20239, 0, 0, 0.428571, 0, 0.485714, 0])
    close([r["overall"] for r in rows], [1.131429, 0.964761, 0, 0, 1.082857, 0, 0.948571, 0])
    plain = rewards.grouped_reward(df, len_weight=0, perc_weight=0).orderBy("row_id").collect()
    close([r["overall"] for r in plain], [r["overall"] for r in rewards.answer_reward(df).orderBy("row_id").collect()])


def test_states_do_not_depend_on_arrival(spark):
    """Row 3 is exactly one deviation below the mean, so that rounding decides; these arrival orders round the other way."""
    schema = "row_id long, uid string, acc double, fmt double, mar double, len double"
    sight, turn = [0.44, 0.86, 0.09, 0.16, 0.05, 0.69, 0.88, 0.99], [7, 3, 6, 4, 5, 0, 2, 1]
    state = lambda order: {r["row_id"]: r["state"] for r in rewards.grouped_reward(spark.createDataFrame([(i, "u", 1.0, 0.0, sight[i], 1.0) for i in order], schema).coalesce(1)).collect()}
    assert state(turn) == state(range(8)) == dict(enumerate("AACCCAAA"))


def test_missing_mar_is_not_zero(spark):
    schema = "row_id long, uid string, acc double, fmt double, mar double, len double"
    none = rewards.grouped_reward(spark.createDataFrame([(i, "u", 1.0, 1.0, None, 10.0 * i + 1) for i in range(4)], schema)).collect()
    assert {(r["state"], r["r_len"], r["mar_available"]) for r in none} == {("D", 0.0, 0.0)}
    zero = rewards.grouped_reward(spark.createDataFrame([(i, "u", 1.0, 1.0, 0.0, 10.0 * i + 1) for i in range(4)], schema)).collect()
    assert {r["state"] for r in zero} == {"C"}


def test_states_of_missing_mar_do_not_depend_on_arrival(spark):
    """As above, with every third mar missing: row 506278 is exactly at the bound."""
    schema = "row_id long, uid string, acc double, fmt double, mar double, len double"
    sight = {506272: 0.91, 506273: 0.72, 506274: None, 506275: 0.24, 506276: 0.19, 506277: None, 506278: 0.15, 506279: 0.40}
    state = lambda order: {r["row_id"]: r["state"] for r in rewards.grouped_reward(spark.createDataFrame([(506272 + i, "u", 0.0, 0.0, sight[506272 + i], 1.0) for i in order], schema).coalesce(1)).collect()}
    assert state([7, 1, 3, 0, 6, 4, 2, 5]) == state(range(8)) and state(range(8))[506278] == "D"


def test_group_advantages(spark):
    df = spark.createDataFrame([(i, "g", float(x)) for i, x in enumerate([1, 0, 1, 0])], "row_id long, uid string, score double")
    close([r["advantage"] for r in advantage.grpo(df).orderBy("row_id").collect()], [0.866024, -0.866024, 0.866024, -0.866024])
    got = [r["advantage"] for r in advantage.rloo(df).orderBy("row_id").collect()]
    close(got, [0.666667, -0.666667, 0.666667, -0.666667])
    assert abs(sum(got)) < 1e-9
    for f in (advantage.grpo, advantage.rloo):
        with pytest.raises(Exception, match="one row"):
            f(df.limit(1)).collect()


def test_gae(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0, 1.0], [0.5, 0.4, 0.3])], "row_id long, rewards array<double>, values array<double>")
    r = advantage.advantage("gae", df, gamma=0.9, lam=0.95).first()
    close(r["returns"], [0.760568, 0.8685, 1.0], 1e-5)
    close(r["advantages"], [-0.981652, -0.035737, 1.01739], 1e-5)


def test_estimators_are_registered():
    assert set(advantage.ESTIMATORS) == {"gae", "grpo", "rloo", "reinforce_plus_plus", "remax"}
    with pytest.raises(ValueError, match="grpo"):
        advantage.register_estimator("grpo")(lambda df: df)


def test_kl(spark):
    row = spark.range(1).select(*[kl.kl_term(F.lit(-1.0), F.lit(-1.5), k).alias(k) for k in ("kl", "abs", "mse", "low_var_kl")]).first()
    close(list(row), [0.5, 0.5, 0.125, 0.106531])
    far = spark.range(1).select(kl.kl_term(F.lit(0.0), F.lit(50.0), "low_var_kl").alias("x")).first()
    assert far["x"] == 10.0


def test_controllers():
    a = kl.controller("adaptive", 0.1, target=0.1, horizon=100)
    a.update(0.5, 10)
    assert math.isclose(a.beta, 0.1 * 1.02)
    b = kl.controller("accuracy_based", 0.05, low=0.0, high=1.0)
    b.update(0.0, 1)
    assert b.beta == 0.05
    b.update(0.0, 1, 0.75)
    assert b.beta == 0.25
    with pytest.raises(ValueError, match="unknown"):
        kl.controller("none", 0.1)


def test_policy_terms(spark):
    df = spark.createDataFrame([(0, -1.0, -0.5, 1.0), (1, -1.0, -1.5, 1.0), (2, -1.0, 0.5, -1.0), (3, -1.0, -1.1, -1.0)], "row_id long, old double, new double, adv double")
    rows = loss.policy_terms(df).orderBy("row_id").collect()
    close([r["token_loss"] for r in rows], [-1.3, -0.606531, 3.0, 0.904837])
    assert [(r["clipped_high"], r["clipped_low"]) for r in rows] == [(1, 0), (0, 0), (0, 1), (0, 0)]


def test_eos_mask(spark):
    df = spark.createDataFrame([([0, 0, 2, 4, 3, 5, 1, 0, 0],), ([2, 3],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(arrays.eos_mask(F.col("ids"), 1)).collect()] == [[1, 1, 1, 1, 1, 1, 1, 0, 0], [1, 1], []]


@pytest.mark.parametrize(("n", "granted"), [(5, 4), (8, 7), (10, 8), (17, 14), (35, 28)])
def test_budget(spark, n, granted):
    df = spark.createDataFrame([(i, 1.0, 0.0, 10.0 if i % 2 else 20.0, 0.5) for i in range(n)], "row_id long, acc double, fmt double, len double, complexity double")
    rows = rewards.thinking_reward(df, size=n).where("len_score <> 0").collect()
    assert sorted(r["row_id"] for r in rows) == list(range(granted))


def test_rank_and_percentile(spark):
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 2, 2, 5])], "g long, x double")
    got = rewards.rank_normalised(df, "g", "x", "n").orderBy("g").collect()
    close([r["n"] for r in got], [0, 0.5, 0.5, 1])
    same = rewards.rank_normalised(df.withColumn("x", F.lit(3.0)), "g", "x", "n").collect()
    assert {r["n"] for r in same} == {0.5}


def test_format_and_tags(spark):
    rows = ["<think>a\nb</think> \\boxed{3} x", "<think>a</think> 3", "pre <think>a</think>\\boxed{}", "<think>a</think>\\boxed{3}\n", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, r string").orderBy("i")
    assert [r[0] for r in df.select(text.format_score(F.col("r"))).collect()] == [1, 0, 0, 1, 0]
    tags = spark.createDataFrame([("a <　b / c\x1c>d",)], "r string")
    assert tags.select(text.normalise_tags(F.col("r"))).first()[0] == "a<b/c>d"


def test_grading():
    assert text.last_boxed("x \\boxed{a{b}c} y") == "a{b}c" and text.last_boxed("\\boxed{a") is None
    same = [("\\boxed{0.5}", "\\frac{1}{2}"), ("\\boxed{-\\frac{3}{4}}", "-0.75"), ("\\boxed{1,234}", "1234"), ("\\boxed{50\\%}", "0.5"), ("\\boxed{ x + 1 }", "x+1"), ("\\boxed{\\text{C}}.", "\\boxed{C}")]
    assert all(text.grade(a, b) == 1.0 for a, b in same)
    assert text.grade("\\boxed{2}", "3") == text.grade("2", "2") == text.grade(None, "2") == text.grade("\\boxed{1}", None) == 0.0


def test_schedule():
    points = [{"epoch_ratio": 1.0, "low": 0.3, "high": 0.99}, {"epoch_ratio": 0.5, "low": 0.01, "high": 0.7}]
    got = [curriculum.scheduled(points, p, {"low": 0.0, "high": 1.0})["low"] for p in (0.2, 0.5, 0.8, 1.2)]
    assert got == [0.01, 0.01, 0.3, 0.3]
    assert curriculum.scheduled([], 0.3, {"low": 0.1}) == {"low": 0.1}
    assert curriculum.scheduled([{"epoch_ratio": 1.0}], 0.3, {"low": 0.1}) == {"low": 0.1}


def test_band_is_strict(spark):
    df = spark.createDataFrame([(i, g, a) for i, (g, a) in enumerate([("a", 1.0), ("a", 0.0), ("b", 1.0), ("b", 1.0), ("c", 0.0), ("c", 0.0)])], "row_id long, uid string, acc double")
    assert {r["uid"] for r in curriculum.group_band(df, 0.0, 1.0).collect()} == {"a"}
    assert {r["uid"] for r in curriculum.group_band(df, 0.99, 1.001).collect()} == {"b"}
    with pytest.raises(Exception, match="groups wanted"):
        curriculum.make_batch(df, 2, 0.0, 1.0).collect()


def test_partitions():
    lengths = [9, 7, 6, 5, 5, 4, 4, 3]
    for by in (partition.differencing, partition.lightest_bin):
        for equal in (True, False):
            parts = partition.balanced_parts(lengths, 4, equal, by)
            assert sorted(i for p in parts for i in p) == list(range(8))
            assert not equal or {len(p) for p in parts} == {2}
    sums = [sum(lengths[i] for i in p) for p in partition.balanced_parts(lengths, 4)]
    assert max(sums) - min(sums) <= 3
    with pytest.raises(ValueError, match="equal parts"):
        partition.balanced_parts(lengths[:7], 4)
    with pytest.raises(ValueError, match="parts"):
        partition.balanced_parts([1, 2], 3)


def test_equal_parts_are_no_further_apart_than_contiguous_ones():
    """Differencing alone gives 204 and 75 here, the first and the last three rows 203 and 76; and always ranges within those."""
    assert partition.differencing([200, 2, 1, 60, 13, 3], 2, True) == [[0, 1, 2], [3, 4, 5]]
    for seed in range(300):
        lengths = [(seed * 7919 + i * i * 104_729) % 97 ** (1 + i % 3) for i in range(24)]
        sums, plain = [sum(lengths[i] for i in p) for p in partition.balanced_parts(lengths, 4)], [sum(lengths[i : i + 6]) for i in range(0, 24, 6)]
        assert min(sums) >= min(plain) and max(sums) <= max(plain)


def test_micro_batches(spark):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate([30, 10, 20, 40, 25, 5])], "batch_id long, row_id long, length long")
    rows = partition.micro_batches(df, 50).collect()
    assert len(rows) == 6 and {r["part"] for r in rows} == {0, 1, 2}
    length = dict(enumerate([30, 10, 20, 40, 25, 5]))
    load = [sum(length[r["row_id"]] ** 2 for r in rows if r["turn"] == t) for t in range(3)]
    assert load == sorted(load, reverse=True)


def test_batch_algebra(spark):
    df = batch.with_row_id(spark.createDataFrame([(x,) for x in (5, 3, 9, 1, 7)], "x long").repartition(3), "x")
    values = lambda d, c="x": [r[c] for r in d.orderBy("row_id").collect()]
    assert values(df) == [1, 3, 5, 7, 9] and values(df, "row_id") == [0, 1, 2, 3, 4]
    assert values(batch.repeat(df, 2)) == [1, 1, 3, 3, 5, 5, 7, 7, 9, 9]
    assert values(batch.repeat(df, 2, interleave=False)) == [1, 3, 5, 7, 9] * 2
    padded = batch.pad_to_multiple(df, 4)
    assert values(padded) == [1, 3, 5, 7, 9, 1, 3, 5] and values(batch.unpad(padded)) == values(df)
    assert values(batch.pad_to_multiple(df, 5)) == values(df)
    assert values(batch.slice_rows(df, -4, None, 2)) == [3, 7]
    assert values(batch.take(df, [4, 0, 0])) == [9, 1, 1] and values(batch.take(df, [])) == []
    assert values(batch.concat(df, df)) == [1, 3, 5, 7, 9] * 2
    assert values(batch.union_columns(df, df.withColumn("y", F.col("x") + 1)), "y") == [2, 4, 6, 8, 10]
    for other in (df.withColumn("x", F.col("x") + 1), batch.limit_rows(df, 3)):
        with pytest.raises(Exception, match="differ"):
            batch.union_columns(df, other).collect()
    with pytest.raises(Exception, match="equal chunks"):
        batch.chunk(df, 2).collect()
    with pytest.raises(KeyError):
        batch.rename_columns(df, ["none"], ["x2"])
    assert values(batch.shuffled(df.drop("row_id"), "x", 1)) == values(batch.shuffled(df.drop("row_id").repartition(4), "x", 1))


def test_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(arrays.pad(F.col("a"), 5, 0)).collect()] == [[1, 2, 3, 0, 0], [0] * 5]
    assert [r[0] for r in df.select(arrays.truncate(F.col("a"), 2, "left")).collect()] == [[2, 3], []]
    with pytest.raises(Exception, match="allowed"):
        df.select(arrays.truncate(F.col("a"), 2, "error")).collect()
    pos = spark.createDataFrame([([0, 0, 1, 1, 0, 1],)], "m array<int>").select(arrays.position_ids(F.col("m"))).first()[0]
    assert pos == [0, 0, 0, 1, 1, 2]
    assert spark.createDataFrame([([0, 1, 2, 0, 1],)], "p array<int>").select(arrays.segment_lengths(F.col("p"))).first()[0] == [3, 2]


def test_grid_positions():
    got = scalar.grid_positions([5, 9, 9, 9, 9, 5], [(1, 4, 4)], [], 9, 8).tolist()
    assert got == [[0, 1, 1, 1, 1, 3], [0, 1, 1, 2, 2, 3], [0, 1, 2, 1, 2, 3]]
    apart = scalar.grid_positions([8, 8, 5, 8, 8], [], [(2, 2, 4)], 9, 8, frames_apart=True).tolist()
    assert apart == [[0, 0, 2, 3, 3], [0, 0, 2, 3, 3], [0, 1, 2, 3, 4]]
    timed = scalar.grid_positions([0, 5, 8, 8, 8, 5, 9], [(1, 2, 2)], [(3, 2, 2)], 9, 8, seconds=[0.75], mask=[0, 1, 1, 1, 1, 1, 1]).tolist()
    assert timed == [[1, 0, 1, 2, 4, 5, 6], [1, 0, 1, 1, 1, 5, 6], [1, 0, 1, 1, 1, 5, 6]]
    assert scalar.grid_positions([4, 4, 4], [], [], 9, 8).tolist() == [[0, 1, 2]] * 3 and scalar.grid_positions([], [], [], 9, 8).shape == (3, 0)


def test_attention_ratios(spark):
    rows = [(0, layer, head, p, 0.1 * (p + 1)) for layer in range(4) for head in range(2) for p in range(8)]
    attn = spark.createDataFrame(rows, "sample long, layer int, head int, resp_pos int, vis_mass double")
    both = spark.createDataFrame([(0,), (1,)], "sample long")
    got = lambda mode: {r["sample"]: round(r["mar"], 6) for r in mar.ratios(both, attn, mode, 4, 2, 8, [(0, 0), (3, 1)]).collect()}
    assert got("mid") == {0: 0.45, 1: 0.0} and got("full_topk") == {0: 0.75, 1: 0.0} and got("vsh") == {0: 0.75, 1: 0.0} and got("disabled") == {0: 0.0, 1: 0.0}


def test_retention_and_tracker(spark, tmp_path):
    paths = spark.createDataFrame([(f"global_step_{i}",) for i in (1, 2, 3, 4, 5)], "path string")
    assert sorted(r["step"] for r in sinks.obsolete_checkpoints(paths, 5, 1, 3).collect()) == [2]
    assert sinks.obsolete_checkpoints(paths, 5, None, 0).count() == 0
    assert sinks.latest_checkpoint(spark, str(tmp_path)) is None
    sinks.save_checkpoint(paths, str(tmp_path), 7, 7, 0.123456)
    path, found = sinks.latest_checkpoint(spark, str(tmp_path))
    assert path.endswith("global_step_7") and found["best_val_reward_score"] == 0.1235
    with pytest.raises(ValueError, match="unknown"):
        sinks.Tracker(["console", "nowhere"], str(tmp_path))
    row = spark.createDataFrame([(3, 0.5)], "step int, `a/b` double")
    sinks.Tracker(["console", "file"], str(tmp_path / "m")).log(row)
    assert spark.read.text(str(tmp_path / "m")).first()[0] == '{"step":3,"a":{"b":0.5}}'


def test_names_and_numbers():
    record = {"a/b": 1, "a/c/d": 2, "e": 3}
    assert scalar.flatten(scalar.unflatten(record)) == record
    assert scalar.device_peak("NVIDIA A100-SXM4", "T") == 312 and scalar.device_peak("unknown") == float("inf")
    assert sinks.show_number(0.123456) == "0.123" and sinks.show_number(1e-7) == "1e-07"


def test_reading(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"q": 1}\n{"q": 2}\n')
    (tmp_path / "b.json").write_text('[{"q": 1, "split": "train"}, {"q": 2, "split": "test"}]')
    assert [r["q"] for r in prompts.read_table(spark, str(tmp_path / "b.json")).collect()] == [1]
    assert prompts.read_table(spark, str(tmp_path / "b.json") + "@test").first()["q"] == 2
    with pytest.raises(ValueError, match="format"):
        prompts.read_table(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        prompts.read_table(spark, str(tmp_path / "none"))


def test_value_loss_and_variance(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0, 0.2), (0, 0.3, 0.0, 0.2), (1, 0.5, 1.0, 0.4)], "row_id long, pred double, returns double, values double")
    r = loss.value_loss(df, 0.5).first()
    close(list(r), [0.5 * (1.0 + 0.09 + 0.25) / 3, 0.0, 0.6], 1e-6)
    flat = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (100.0, 0.0)], "x double, m double")
    assert math.isclose(metrics.masked_variance(flat, "x", "m").first()[0], 2.0, rel_tol=1e-6)
