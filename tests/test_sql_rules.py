"""Rules as table functions of SQL."""

import pytest
from pyspark.errors import PySparkException

from trajectra.plans.sql_rules import register_rules

RULES = """
def ranked(rows):
    return [{"place": i, "of": len(rows)} for i, _ in enumerate(rows)]

def short(rows):
    return []

def doubled(row):
    return {"x": None if row["v"] is None else row["v"] * 2}
"""


@pytest.fixture()
def rules(spark, tmp_path):
    register_rules(spark)
    (tmp_path / "rules.py").write_text(RULES)
    spark.createDataFrame([(5, "a", 1.0, 9), (3, "a", None, 9), (4, None, 2.0, 9), (9, None, 4.0, 9), (9, "b", 4.0, 9)], "id int, g string, v double, place long").createOrReplaceTempView("sql_rule_rows")
    return f"{tmp_path}/rules.py"


@pytest.mark.parametrize("dealt", ["TABLE(sql_rule_rows), batch => 'g'", "TABLE(sql_rule_rows) PARTITION BY g ORDER BY id"])
def test_batches_are_whole_and_in_order(spark, rules, dealt):
    got = spark.sql(f"SELECT * FROM batch_rule({dealt}, rule => '{rules}:ranked', outputs => 'place, of', id => 'id')")
    assert got.dtypes == [("id", "int"), ("place", "double"), ("of", "double")]
    assert sorted(map(tuple, got.collect())) == [(3, 0, 2), (4, 0, 2), (5, 1, 2), (9, 0, 1), (9, 1, 2)]


def test_rows_one_by_one(spark, rules):
    got = spark.sql(f"SELECT * FROM row_rule(TABLE(sql_rule_rows), rule => '{rules}:doubled', outputs => 'x', id => 'id')").collect()
    assert sorted(map(str, map(tuple, got))) == ["(3, None)", "(4, 4.0)", "(5, 2.0)", "(9, 8.0)", "(9, 8.0)"]


def test_without_rows(spark, rules):
    got = spark.sql(f"SELECT * FROM batch_rule(TABLE(SELECT * FROM sql_rule_rows WHERE id < 0), batch => 'g', rule => '{rules}:ranked', outputs => 'place', id => 'id')")
    assert got.collect() == []


@pytest.mark.parametrize(
    ("call", "says"),
    [
        ("batch_rule(TABLE(sql_rule_rows), batch => 'q', rule => '{}:ranked', outputs => 'place', id => 'id')", "no column q"),
        ("batch_rule(TABLE(sql_rule_rows), batch => 'g', rule => '{}:gone', outputs => 'place', id => 'id')", "no function gone"),
        ("row_rule(TABLE(sql_rule_rows), rule => '{}:doubled', outputs => 'x')", "no column row_id"),
    ],
)
def test_wrong_calls_fail_when_planned(spark, rules, call, says):
    with pytest.raises(PySparkException, match=says):
        spark.sql("SELECT * FROM " + call.format(rules))


def test_a_rule_that_loses_rows_raises(spark, rules):
    with pytest.raises(PySparkException, match="0 records for"):
        spark.sql(f"SELECT * FROM batch_rule(TABLE(sql_rule_rows), batch => 'g', rule => '{rules}:short', outputs => 'place', id => 'id')").collect()
