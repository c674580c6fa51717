import collections

import pytest
from pyspark.sql import functions as F

from trajectra.functions.permutation import place_of, row_at, sides
from trajectra.sources.epochs import _Ranges, mini_batches, sampled, shuffled_epochs


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 64, 101, 1000])
def test_every_epoch_is_a_permutation_of_its_own(spark, n):
    rows = spark.range(n).withColumn("e", F.explode(F.array(F.lit(0), F.lit(1), F.lit(9))))
    got = rows.select("id", "e", place_of(F.col("id"), n, 5, F.col("e")).alias("p")).withColumn("back", row_at(F.col("p"), n, 5, F.col("e"))).collect()
    orders = collections.defaultdict(dict)
    for r in got:
        orders[r["e"]][r["id"]] = r["p"]
        assert r["back"] == r["id"]
    for order in orders.values():
        assert sorted(order.values()) == list(range(n))
    if n >= 64:
        assert orders[0] != orders[1] != orders[9]
        # No place is near its row more often than by chance, about 2 in n.
        assert sum(abs(i - p) <= 1 for i, p in orders[0].items()) < 0.2 * n


def test_sides_hold_all_with_little_to_spare():
    for n in (1, 2, 3, 4, 5, 9, 10, 99, 100, 101, 10**12, 10**12 + 1):
        a, b = sides(n)
        assert n <= a * b < n + a


def test_outside_there_is_no_place(spark):
    got = spark.createDataFrame([(-1,), (10,), (None,)], "x long").select(place_of(F.col("x"), 10, 1).alias("p"), row_at(F.col("x"), 10, 1).alias("r")).collect()
    assert all(r["p"] is None and r["r"] is None for r in got)


def test_ranges_of_an_epoch():
    for n, batch, drop, want in ((10, 4, True, [(0, 0, 4), (0, 4, 8), (1, 0, 4)]), (10, 4, False, [(0, 0, 4), (0, 4, 8), (0, 8, 10), (1, 0, 4)]), (3, 4, True, []), (0, 4, False, [])):
        source, at, got = _Ranges(n, batch, 0, drop), {"epoch": 0, "place": 0}, []
        for _ in want:
            rows, at = source.read(at)
            got += rows
        assert got == want
        assert list(source.readBetweenOffsets({"epoch": 0, "place": 0}, at)) == want
    done = _Ranges(4, 4, 2, True)
    assert list(done.read({"epoch": 2, "place": 0})[0]) == []


def run(spark, tmp, n, batch, epochs, most, out):
    """Until the source ends, or until most triggers have run."""
    seen = []

    def write(df, number):
        df.withColumn("trigger", F.lit(number)).write.mode("overwrite").parquet(f"{out}/{number:05}")
        seen.append(number)
        if most and len(seen) == most:
            raise RuntimeError("killed between batches")

    query = mini_batches(spark, n, batch, 3, epochs, drop_last=False).writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp}/checkpoint").start()
    try:
        query.processAllAvailable()
    except Exception:  # noqa: BLE001  the kill
        pass
    finally:
        query.stop()


def test_a_killed_stream_goes_on_where_it_was(spark, tmp_path):
    n, batch, epochs, out = 50, 15, 2, str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    for most in (2, 3, 0):
        run(spark, tmp_path, n, batch, epochs, most, out)
    rows = [r for d in sorted((tmp_path / "out").iterdir()) for r in spark.read.parquet(str(d)).collect()]
    assert len(rows) == n * epochs
    for e in range(epochs):
        own = sorted((r["place"], r["row_id"], r["mini"]) for r in rows if r["epoch"] == e)
        assert [p for p, *_ in own] == list(range(n)) and sorted(i for _, i, _ in own) == list(range(n))
        assert all(m == p // batch for p, _, m in own)
    # Each trigger was one mini-batch, and they came in order.
    triggers = collections.defaultdict(set)
    for r in rows:
        triggers[r["trigger"]].add((r["epoch"], r["mini"]))
    assert [triggers[t] for t in sorted(triggers)] == [{(e, m)} for e in range(epochs) for m in range(4)]


def test_epochs_of_a_table(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") * 2).alias("x"))
    placed = shuffled_epochs(df, 3, 30, 4)
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    rows = placed.collect()
    assert collections.Counter(r["epoch"] for r in rows) == {0: 100, 1: 100, 2: 100}
    first = {(r["place"], r["row_id"], r["x"]) for r in sampled(df, 7, 4).collect()}
    assert first == {(r["place"], r["row_id"], r["x"]) for r in rows if r["epoch"] == 0 and r["place"] < 7}
    assert sampled(df, 1000, 4).count() == 100 and sampled(df.limit(0), 5, 4).count() == 0
