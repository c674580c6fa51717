import random

import pytest

from trajectra.streaming.collect import collect_groups, keyed_state

ROWS = "run string, mini long, uid string, acc double"


def brute(minis, target, low=0.01, high=0.99):
    """minis: run -> list of {uid: accuracies}."""
    out = []
    for run, listed in minis.items():
        step, tries, held = 0, 0, []
        for groups in listed:
            tries += 1
            for uid in sorted(groups):
                known = [a for a in groups[uid] if a is not None]
                if known and low < sum(known) / len(known) < high:
                    held.append(uid)
            if len(held) >= target:
                out += [(run, step, i, uid, tries) for i, uid in enumerate(held[:target])]
                step, tries, held = step + 1, 0, []
    return sorted(out)


def run(spark, at, target, **options):
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{at}/in/*")
    with keyed_state(spark):
        query = collect_groups(stream, target, **options).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema("run string, step long, place long, uid string, tries long").parquet(f"{at}/out").collect())


def test_groups_are_carried_over_mini_batches_and_restarts(spark, tmp_path):
    rng = random.Random(2)
    minis = {name: [{f"{name}{m}-{g:02}": [rng.choice([0.0, 1.0, 1.0, None]) for _ in range(4)] for g in range(rng.randint(1, 6))} for m in range(12)] for name in ("a", "b")}
    (tmp_path / "in").mkdir()

    def put(k, first, last):
        rows = [(name, m, uid, x) for name, listed in minis.items() for m in range(first, last) for uid, xs in listed[m].items() for x in xs]
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    put(0, 0, 2)
    put(1, 2, 5)
    first = run(spark, tmp_path, 7)
    put(2, 5, 12)
    second = run(spark, tmp_path, 7)
    assert second == brute(minis, 7) and set(first) < set(second) and {r[0] for r in second} == {"a", "b"}


def test_a_batch_that_is_not_filled_raises(spark, tmp_path):
    spark.createDataFrame([("a", m, f"g{m}", float(m == 2)) for m in range(4)], ROWS).write.parquet(f"{tmp_path}/in/0")
    with pytest.raises(Exception, match="3 mini-batches didn't give 2 groups"):
        run(spark, tmp_path, 2, max_tries=3)
