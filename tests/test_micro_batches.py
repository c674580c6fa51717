"""Micro-batches of several ranks."""

import pytest
from pyspark.errors import PySparkException

from trajectra.operators.partition import micro_batches

ROWS = [(b, i, n, b // 2) for b, lengths in enumerate([[9, 1, 1], [1, 1, 1], [2, 2, 2], [5, 5, 5]]) for i, n in enumerate(lengths)]
SCHEMA = "batch_id long, row_id long, length long, step long"


def _parts(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["batch_id"], {}).setdefault(r["part"], []).append(r["row_id"])
    return out


def test_ranks_of_a_step_take_as_many_parts_as_the_one_that_needs_most(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    alone, joint = _parts(micro_batches(df, 6)), _parts(micro_batches(df, 6, together="step"))
    assert {b: len(p) for b, p in alone.items()} == {0: 2, 1: 1, 2: 1, 3: 3}
    assert {b: len(p) for b, p in joint.items()} == {0: 2, 1: 2, 2: 3, 3: 3}
    assert all(sorted(i for p in parts.values() for i in p) == [0, 1, 2] for parts in joint.values())


def test_a_rank_with_too_few_rows_raises(spark):
    df = spark.createDataFrame([(0, 0, 9, 0), (0, 1, 9, 0), (1, 0, 1, 0)], SCHEMA)
    with pytest.raises(PySparkException, match="1 rows for 2 parts"):
        micro_batches(df, 9, together="step").collect()
