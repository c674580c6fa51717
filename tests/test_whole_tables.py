"""Queries take in every row of their tables, whatever its ids are; positions are dense whatever the plan does."""

import pytest
from pyspark.sql import functions as F

from trajectra.operators import batch, rewards
from trajectra.plans import catalog


def test_balance_deals_every_document(spark, tmp_path):
    """Ids with gaps, one that repeats, a null one, and a last batch of three rows."""
    rows = [(i * 3, 10 + i % 17) for i in range(513)] + [(0, 99), (None, 5)]
    spark.createDataFrame(rows, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("q_balance", "q_lightest_bin"):
        got = catalog.queries()[name](spark, str(tmp_path)).collect()
        assert sum(r["rows"] for r in got) == 515 and sum(r["chars"] for r in got) == sum(n for _, n in rows)
        assert sorted((r["batch_id"], r["parts"], r["rows"], r["even"]) for r in got if r["rows"] == 256) == [(0, 8, 256, True), (1, 8, 256, True)]
        assert [(r["parts"], r["rows"]) for r in got if r["batch_id"] == 2] == [(3, 3)]


def test_fold_pads_a_table_that_does_not_divide(spark, tmp_path):
    rows = [(i * 5, f"c{i}", 0.0) for i in range(123)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["row_id"]: r["keys"].split(",") for r in catalog.queries()["q_fold"](spark, str(tmp_path)).collect()}
    keys = [str(r[0]) for r in rows]
    assert [k for i in range(10) for k in got[i]] == keys + keys[:7] and {len(k) for k in got.values()} == {13}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_row_ids_are_dense_over_many_ranges(spark, tmp_path, adaptive):
    """A third of the rows has one key, many are equal altogether, and the rows are wide enough for many partitions."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 300_000
        key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 31 == 0, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
        df = spark.range(0, n, 1, 24).select(key.alias("key"), F.repeat(F.sha2(F.floor(F.col("id") / 2).cast("string"), 256), 2).alias("payload"))
        df.write.parquet(f"{tmp_path}/rows")
        df = spark.read.parquet(f"{tmp_path}/rows")
        ids = batch.with_row_id(df, "key")
        masked = batch.where_mask(ids, F.col("key") != 7)
        mixed = batch.shuffled(df, "key", 3)
        for name, x, want in (("ids", ids, n), ("masked", masked, df.where("key <> 7").count()), ("mixed", mixed, n)):
            x.write.parquet(f"{tmp_path}/{name}")
            got = spark.read.parquet(f"{tmp_path}/{name}")
            row = got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("d"), F.min("row_id").alias("a"), F.max("row_id").alias("b")).first()
            assert (row["n"], row["d"], row["a"], row["b"]) == (want, want, 0, want - 1)
            ahead = got.alias("x").join(got.alias("y"), F.col("x.row_id") + 1 == F.col("y.row_id"))
            if name != "mixed":
                assert ahead.where("x.key > y.key or y.key is null and x.key is not null").isEmpty()
        passes = batch.epochs(ids.select("row_id"), 2, 1000, 5)
        sizes = passes.groupBy("epoch", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("d")).collect()
        assert len(sizes) == 2 * n // 1000 and all(r["n"] == r["d"] == 1000 for r in sizes)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_percentile_and_ranks_over_many_ranges(spark):
    df = spark.range(200_000).select(F.col("id").alias("k"), F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 150_001) / 7.0).alias("x"))
    want = df.agg(F.expr("percentile(x, 0.8)")).first()[0]
    assert spark.range(1).select(rewards.percentile(df, "x", 0.8).alias("p")).first()["p"] == pytest.approx(want, rel=1e-12)
    ranked = rewards.rank_normalised(df.where("x is not null"), "k", "x", "r").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.avg("r").alias("m")).first()
    assert 0 <= ranked["a"] < 1e-4 and 1 - 1e-4 < ranked["b"] <= 1 and ranked["m"] == pytest.approx(0.5)


def test_rows_by_place(spark):
    df = batch.from_columns(spark, {"x": list(range(10, 20)), "y": [[i, i] for i in range(10)]})
    got = lambda item: [r["x"] - 10 for r in batch.get_rows(df, item).orderBy("row_id").collect()]
    plain = list(range(10))
    for s in (slice(None), slice(2, -2), slice(-3, None), slice(None, None, -1), slice(-2, 1, -3), slice(50, None), slice(None, 50, 4), slice(8, 2), slice(50, None, -4), slice(-50, 3)):
        assert got(s) == plain[s], s
    assert got([3, -1, 3]) == [3, 9, 3] and got([True, False] * 5) == [0, 2, 4, 6, 8] and got(-1) == [9] and got(F.col("x") > 17) == [8, 9]
    with pytest.raises(IndexError):
        batch.get_rows(df, 10)
    with pytest.raises(TypeError):
        batch.get_rows(df, "x")
    with pytest.raises(ValueError):
        batch.from_columns(spark, {"x": [1], "y": [1, 2]})
    with pytest.raises(TypeError):
        batch.from_columns(spark, {"x": "abc"})
    assert batch.from_columns(spark, {"x": []}, {"x": "double"}).count() == 0
    with pytest.raises(Exception, match="different lengths"):
        batch.checked_lengths(df.withColumn("z", F.array("x")), ["y", "z"]).collect()
    assert batch.merge_records({"a": 1}, {"b": 2, "a": 1}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        batch.merge_records({"a": 1}, {"a": 2})
