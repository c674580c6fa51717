"""What one task or one call of a worker takes doesn't grow with the tables."""

from pyspark.sql import functions as F

from trajectra.operators import batch
from trajectra.plans import catalog, registry
from trajectra.sources import prompts


def test_texts_are_encoded_a_few_at_a_time():
    sizes = []

    class Counting:
        def encode_batch(self, texts, add_special_tokens):
            sizes.append(len(texts))
            return [type("Encoding", (), {"ids": list(range(len(t)))}) for t in texts]

    texts = [None if i % 7 == 0 else "x" * (i % 5) for i in range(1000)]
    assert [len(x) for x in prompts.encoded(Counting(), texts)] == [len(t or "") for t in texts]
    assert sum(sizes) == 1000 and max(sizes) <= prompts.ENCODED


def test_batches_of_a_rule_share_calls_of_the_worker(spark):
    """Batches lie across Arrow batches; a null batch is one, rows without an id stay, and a long batch comes whole."""
    rows = [(i, (i * 7919) % 2500, float(i % 13), "t") for i in range(10_000)] + [(None, None, 5.0, None), (7, None, 10.0, "u"), (20_000, None, None, "v")]
    rows += [(30_000 + i, -1, float(i), "long") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id long, batch_id long, x double, kept string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        out = registry.score_batches(df, lambda rs: [{"n": len(rs), "turn": k} for k, r in enumerate(rs)], ["x"], ["n", "turn"])
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "FlatMapGroups" not in plan
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) and out.columns == ["row_id", "batch_id", "x", "kept", "n", "turn"]
    assert {r["batch_id"]: r["n"] for r in got} == {None: 3.0, -1: 3000.0, **{i: 4.0 for i in range(2500)}}
    assert all(r["turn"] == r["x"] for r in got if r["batch_id"] == -1)


def test_a_small_file_of_dear_rows_is_many_tasks(spark, tmp_path):
    spark.range(25_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("q_grid_positions", "q_grid_frames"):
        assert catalog.queries()[name](spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_rows_are_dealt_to_ranges_without_copies_of_their_keys(spark, monkeypatch):
    """The tasks that deal rows to ranges keep them all in memory: their splits are small and keys that are columns aren't carried twice."""
    seen, plain = {}, batch.written

    def watched(df):
        seen["split"] = int(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b"))
        seen["plan"] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df)

    monkeypatch.setattr(batch, "written", watched)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    df = spark.range(60_000).select((F.col("id") % 1000).alias("a"), "id")
    got = batch.with_row_id(df, "a", "id").agg(F.count_distinct("row_id"), F.max("row_id")).first()
    assert tuple(got) == (60_000, 59_999) and "__ord_k" not in seen["plan"] and seen["split"] <= 16 << 20
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_forms_of_an_array_are_made_in_one_pass(spark):
    for name in ("q_pad_truncate", "q_position_ids"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Union" not in plan
