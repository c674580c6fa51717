"""Positions of images' and videos' cells, of many sequences at once."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from trajectra.functions import scalar
from trajectra.plans import catalog


def walked(ids, images, videos, seconds, apart):
    """Token after token."""
    films = [([1, h, w], 0.0) for t, h, w in videos for _ in range(t)] if apart else list(zip(videos, seconds))
    todo, out, base, at = {9: [(g, 0.0) for g in images], 8: films}, [], 0, 0
    while at < len(ids):
        if not todo.get(ids[at]):
            out.append((base, base, base))
            base, at = base + 1, at + 1
            continue
        (t, h, w), step = todo[ids[at]].pop(0)
        cells = [(base + int(i * step * scalar.STEPS_PER_SECOND), base + j, base + k) for i in range(t) for j in range(h // 2) for k in range(w // 2)]
        base = max([base - 1, *[max(c) for c in cells]]) + 1
        out, at = out + cells, at + len(cells)
    return out[: len(ids)]


def sequences(n):
    """Runs of both kinds and of text, longer and shorter than their grids; grids without cells; more and fewer grids than runs."""
    rng = random.Random(3)
    for _ in range(n):
        ids = [x for _ in range(rng.randint(0, 8)) for x in [rng.choice([1, 1, 9, 8])] * rng.randint(1, 7)]
        images, videos = ([[rng.randint(0, 3), rng.randint(0, 6), rng.randint(0, 6)] for _ in range(rng.randint(0, 4))] for _ in range(2))
        yield ids, images, videos, [rng.choice([0.0, 0.25, 0.75, 1.5]) for _ in range(rng.randint(0, 5))]


def arrow(rows):
    kinds = (pa.list_(pa.int32()), pa.list_(pa.list_(pa.int32())), pa.list_(pa.list_(pa.int32())), pa.list_(pa.float64()))
    return tuple(pa.array(c, kind) for c, kind in zip(zip(*rows), kinds))


@pytest.mark.parametrize("apart", [False, True])
def test_positions_of_a_batch_are_made_at_once(spark, monkeypatch, apart):
    sizes, plain = [], scalar._grid_positions

    def counting(lengths, *rest):
        sizes.append(int(lengths.sum()))
        return plain(lengths, *rest)

    monkeypatch.setattr(scalar, "_grid_positions", counting)
    rows = list(sequences(2000))
    batch, run = arrow(rows), scalar.grid_positions_udf(9, 8, frames_apart=apart).func
    want = [walked(*r, apart) for r in rows]
    made = lambda batches: [[tuple(c.values()) for c in p] for out in run(iter(batches)) for p in out.to_pylist()]
    assert made([batch]) == want and len(sizes) == 1
    monkeypatch.setattr(scalar, "GRID_TOKENS", 300)
    assert made([tuple(c.slice(0, 1500) for c in batch), tuple(c.slice(0, 0) for c in batch), tuple(c.slice(1500) for c in batch)]) == want
    assert len(sizes) > 50 and max(sizes[1:]) <= 300 + max(len(r[0]) for r in rows)


def test_nulls_among_sequences(spark):
    run = scalar.grid_positions_udf(9, 8).func
    batch = arrow([([1, None, 9], [[1, 2, 2]], [], []), (None, [[1, None, 2]], [[None, 1, 1]], None), ([], [], [], []), ([9, 1], None, None, [])])
    at = lambda *p: [{"time": i, "height": i, "width": i} for i in p]
    assert next(run(iter([batch]))).to_pylist() == [at(0, 1, 2), None, [], at(0, 1)]
    for images, seconds in (([[1, None, 2]], []), ([[1, 2]], []), ([[1, -2, 2]], []), ([], None)):
        with pytest.raises(ValueError):
            next(run(iter([arrow([([9], images, [], seconds)])])))
    with pytest.raises(ValueError):
        scalar.grid_positions([8], [], [(1, 2, 2)], 9, 8, seconds=[None])


def test_many_images_in_a_sequence():
    """A round an image, whatever its place; positions by formula: text, a cell, text, a cell."""
    got = scalar.grid_positions([1, 9] * 3000, [(1, 2, 2)] * 3000, [], 9, 8)
    assert (got == np.arange(6000)).all()


def test_grid_queries_with_a_null_and_a_repeated_key(spark, tmp_path):
    keys = [(i * 7 % 250,) for i in range(240)] + [(3,), (None,)]
    spark.createDataFrame(keys, "c_custkey long").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        for name in ("q_grid_positions", "q_grid_frames"):
            got = catalog.queries()[name](spark, str(tmp_path))
            assert got.columns == ["row_id", "pos", "time", "height", "width"]
            assert sorted(map(tuple, got.collect())) == sorted(db.execute(catalog.oracle_sql()[name]).fetchall())


def test_positions_are_asked_for_once_and_after_rows_are_dealt(spark):
    for name in ("q_grid_positions", "q_grid_frames"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Exchange")
