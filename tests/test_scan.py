import random

import pytest
from pyspark.sql import functions as F

from trajectra.functions import arrays
from trajectra.operators import advantage, scan
from trajectra.operators.scan import gae_tokens, linear_recurrence, reinforce_plus_plus_tokens


def brute(values, factors, reverse=False):
    y, out = 0.0, []
    for x, f in reversed(list(zip(values, factors))) if reverse else zip(values, factors):
        y = x + f * y
        out.append(y)
    return out[::-1] if reverse else out


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 128, 129, 700])
def test_arrays_of_any_length(spark, n):
    rng = random.Random(n)
    x, f = [rng.uniform(-1, 1) for _ in range(n)], [rng.choice([0.0, 0.5, 0.9, 1.0]) for _ in range(n)]
    df = spark.createDataFrame([(x, f, [int(v > 0) for v in x])], "x array<double>, f array<double>, m array<int>")
    got = df.select(arrays.linear_scan(F.col("x"), F.col("f")).alias("a"), arrays.reverse_scan(F.col("x"), 0.9).alias("b"), arrays.reverse_scan(F.col("x"), F.col("f")).alias("c"), arrays.position_ids(F.col("m")).alias("p")).first()
    assert got["a"] == pytest.approx(brute(x, f))
    assert got["b"] == pytest.approx(brute(x, [0.9] * n, True))
    assert got["c"] == pytest.approx(brute(x, f, True))
    assert got["p"] == [max(sum(v > 0 for v in x[: i + 1]) - 1, 0) for i in range(n)]


def test_null_arrays_stay_null(spark):
    df = spark.createDataFrame([(None,)], "x array<double>")
    assert df.select(arrays.linear_scan(F.col("x"), 0.5)).first()[0] is None


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("reverse", [False, True])
def test_blocks_of_a_sequence(spark, levels, reverse, monkeypatch):
    """Gaps, nulls, resets, a null key, sequences of one token and of many blocks of blocks."""
    monkeypatch.setattr(scan, "BLOCK", 5)
    rng = random.Random(1)
    rows = [(key, pos * 3 % 1009 if key == 2 else pos, rng.uniform(-1, 1) if rng.random() < 0.95 else None, rng.choice([0.0, 0.9, 0.9, 1.0, 1.0]) if rng.random() < 0.97 else None) for key, n in ((1, 1), (2, 300), (3, 1000), (None, 40)) for pos in range(n)]
    df = spark.createDataFrame(rows, "key int, pos long, x double, f double").withColumn("y", F.lit("replaced")).withColumn("__t_", F.lit(1))
    got = linear_recurrence(df, "key", "pos", "x", F.col("f"), "y", reverse=reverse, block=5, levels=levels)
    assert got.columns == df.drop("y").columns + ["y"] and got.count() == len(rows)
    found = {(r["key"], r["pos"]): r["y"] for r in got.collect()}
    for key in (1, 2, 3, None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        want = brute([r[2] or 0.0 for r in own], [r[3] or 0.0 for r in own], reverse)
        assert [found[key, r[1]] for r in own] == pytest.approx(want)


def test_one_long_sequence_lies_on_several_tasks(spark):
    n = 300_000
    df = spark.range(n).select(F.lit("one").alias("key"), F.col("id").alias("pos"), (F.col("id") % 7).cast("double").alias("x"))
    got = linear_recurrence(df, "key", "pos", "x", 0.999, reverse=True)
    y, want = 0.0, [0.0] * n
    for i in reversed(range(n)):
        y = want[i] = i % 7 + 0.999 * y
    rows = got.withColumn("task", F.spark_partition_id()).select("pos", "y", "task").collect()
    assert len(rows) == n and len({r["task"] for r in rows}) > 1
    assert max(abs(r["y"] - want[r["pos"]]) for r in rows) < 1e-6


def test_estimators_of_tokens_are_those_of_arrays(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(n)], [rng.uniform(-1, 1) for _ in range(n)]) for i, n in enumerate((1, 2, 5, 6, 31))]
    wide = spark.createDataFrame(rows, "row_id int, rewards array<double>, values array<double>")
    long = wide.select("row_id", F.posexplode(F.arrays_zip("rewards", "values")).alias("pos", "x")).select("row_id", "pos", F.col("x.rewards").alias("reward"), F.col("x.values").alias("value"))
    for arrays_, tokens in ((advantage.gae(wide, gamma=0.9), gae_tokens(long, gamma=0.9, block=5)), (advantage.reinforce_plus_plus(wide, gamma=0.9), reinforce_plus_plus_tokens(long, gamma=0.9, block=5))):
        got = {(r["row_id"], r["pos"]): (r["advantages"], r["returns"]) for r in tokens.collect()}
        want = {(r["row_id"], t): (a, b) for r in arrays_.collect() for t, (a, b) in enumerate(zip(r["advantages"], r["returns"]))}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_masked_tokens_hand_nothing_on(spark):
    """As a padded row with a mask: what stands before a masked token doesn't see what comes after it."""
    rewards, mask = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], [1, 1, 0, 1, 1, 0]
    df = spark.createDataFrame([("a", i, r, m) for i, (r, m) in enumerate(zip(rewards, mask))], "row_id string, pos int, reward double, mask int")
    got = {r["pos"]: r for r in reinforce_plus_plus_tokens(df, mask="mask", gamma=0.5, block=2).collect()}
    running, want = 0.0, {}
    for t in reversed(range(6)):
        running = rewards[t] + 0.5 * running
        want[t] = running
        running *= mask[t]
    assert all(got[t]["returns"] == pytest.approx(want[t] if mask[t] else 0.0) for t in want)
    valid = [want[t] for t in want if mask[t]]
    mean = sum(valid) / len(valid)
    dev = (sum((x - mean) ** 2 for x in valid) / (len(valid) - 1)) ** 0.5
    assert all(got[t]["advantages"] == pytest.approx((want[t] - mean) / dev if mask[t] else 0.0, abs=1e-6) for t in want)


def test_empty(spark):
    df = spark.createDataFrame([], "row_id int, pos int, reward double, value double")
    assert gae_tokens(df).count() == reinforce_plus_plus_tokens(df).count() == linear_recurrence(df, "row_id", "pos", "reward", 0.5).count() == 0
