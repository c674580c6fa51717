import threading

import pytest

from trajectra.sources import commits, sinks


def folder(tmp_path):
    return f"file://{tmp_path}/run"


def test_each_commit_is_found_until_the_next(spark, tmp_path):
    at = folder(tmp_path)
    assert sinks.latest_checkpoint(spark, at) is None
    for step, rows in ((10, 3), (20, 5), (30, 0)):
        sinks.save_checkpoint(spark.range(rows), at, step, 10, 0.123456)
        path, found = sinks.latest_checkpoint(spark, at)
        assert found["last_global_step"] == step and found["best_val_reward_score"] == 0.1235 and spark.read.parquet(path).count() == rows
        assert path.endswith(f"/global_step_{step}")
    assert commits.numbers(spark, at) == [2, 1, 0]


@pytest.mark.parametrize("dies_in", ["_write", "_publish"])
def test_who_dies_leaves_the_commit_before(spark, tmp_path, monkeypatch, dies_in):
    at = folder(tmp_path)
    sinks.save_checkpoint(spark.range(3), at, 10, None, None)

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(commits, dies_in, die)
        with pytest.raises(KeyboardInterrupt):
            sinks.save_checkpoint(spark.range(9), at, 20, None, None)
    assert sinks.latest_checkpoint(spark, at)[1]["last_global_step"] == 10
    sinks.save_checkpoint(spark.range(9), at, 20, None, None)
    path, found = sinks.latest_checkpoint(spark, at)
    assert found["last_global_step"] == 20 and spark.read.parquet(path).count() == 9


def test_what_is_broken_or_lost_is_passed_over(spark, tmp_path):
    at = folder(tmp_path)
    for step in (10, 20, 30):
        sinks.save_checkpoint(spark.range(step), at, step, None, None)
    (tmp_path / f"run/commits/{2:020}.json").write_text('{"number": 2, "da')
    assert sinks.latest_checkpoint(spark, at)[1]["last_global_step"] == 20
    (tmp_path / "run" / commits.latest(spark, at)["data"] / "_SUCCESS").unlink()
    assert sinks.latest_checkpoint(spark, at)[1]["last_global_step"] == 10
    # The next one still gets a number of its own.
    assert sinks.save_checkpoint(spark.range(1), at, 40, None, None)["number"] == 3


def test_of_two_writers_one_wins(spark, tmp_path):
    at = folder(tmp_path)
    first = sinks.save_checkpoint(spark.range(1), at, 10, None, None)["number"]
    won, lost = [], []

    def write(step):
        try:
            won.append(sinks.save_checkpoint(spark.range(step), at, step, None, None, after=first)["last_global_step"])
        except commits.Conflict:
            lost.append(step)

    threads = [threading.Thread(target=write, args=(step,)) for step in (20, 21, 22, 23)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 3
    path, found = sinks.latest_checkpoint(spark, at)
    assert found["last_global_step"] == won[0] and spark.read.parquet(path).count() == won[0]
