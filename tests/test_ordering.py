import pytest
from pyspark.sql import functions as F

from trajectra.operators import batch


def test_equal_rows_lie_in_many_ranges(spark):
    df = spark.range(0, 600_000, 1, 6).select(F.lit("same").alias("x"))
    ids = batch.with_row_id(df, "x")
    parts = batch._ordered(df, ("x",)).groupBy("__ord_part").count().collect()
    assert len(parts) >= 12 and max(r["count"] for r in parts) < 120_000
    row = ids.agg(F.count_distinct("row_id").alias("d"), F.min("row_id").alias("a"), F.max("row_id").alias("b")).first()
    assert (row["d"], row["a"], row["b"]) == (600_000, 0, 599_999)


def test_an_input_by_chance_is_numbered_once(spark):
    df = spark.range(0, 120_000, 1, 5).select("id", F.rand().alias("x"))
    rows = batch.with_row_id(df, "x")
    first, second = ({r["row_id"]: (r["id"], r["x"]) for r in rows.collect()} for _ in range(2))
    assert first == second and sorted(first) == list(range(120_000))
    keys = [first[i][1] for i in range(120_000)]
    assert keys == sorted(keys) and len({i for i, _ in first.values()}) == 120_000


def test_bucketed_tables_are_joined_without_a_shuffle(spark):
    rows = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") * 3).alias("x"))
    names = [f"zip_{k}" for k in "abcd"]
    try:
        a = batch.bucketed(rows.withColumn("a", F.lit("a")), names[0], 8)
        b = batch.bucketed(rows.withColumn("b", F.lit("b")), names[1], 8)
        both = batch.union_columns(a, b)
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert both.columns == ["row_id", "x", "a", "b"] and both.where("x = 3 * row_id and a = 'a' and b = 'b'").count() == 2000
        other = batch.bucketed(rows.withColumn("x", F.col("x") + (F.col("row_id") == 77).cast("int")), names[2], 8)
        short = batch.bucketed(rows.where("row_id < 1999").drop("x"), names[3], 8)
        for wrong in (other, short):
            with pytest.raises(Exception, match="batches differ"):
                batch.union_columns(a, wrong).collect()
    finally:
        for name in names:
            spark.sql(f"drop table if exists {name}")


def test_empty(spark):
    assert batch.with_row_id(spark.createDataFrame([], "x int"), "x").count() == 0
    assert batch.cumulative(spark.createDataFrame([], "x int"), "x", value=F.col("x")).count() == 0
