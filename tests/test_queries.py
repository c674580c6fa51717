"""Every query of the catalog runs on the smallest tables; those with SQL are held against DuckDB."""

import math
import os

import duckdb
import pytest

from trajectra.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, oracle, name):
    got = catalog.queries()[name](spark, DIR)
    if name not in catalog.oracle_sql():
        assert got.count() > 0
        return
    want = oracle.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry_without_corpus_queries(spark, monkeypatch):
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("trajectra.llm")] + ["corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "trajectra.llm", None)
    assert set(__spark_entry__.queries()) == set(catalog.queries())
    assert __spark_entry__.entry(spark).count() == 1


def test_prompts_are_counted_as_the_tokenizer_does(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = catalog.queries()["q_overlong_tokens"](spark, DIR).collect()
    asked = spark.read.parquet(f"{DIR}/conversations.parquet").where("role = 'user'").collect()
    text = {(r["conv_id"], r["turn"]): f"<|im_start|>user\n{r['text'].strip(' ')} Reason.<|im_end|>\n<|im_start|>assistant\n" for r in asked}
    size = {k: len(made.encode(t, add_special_tokens=False).ids) for k, t in text.items()}
    assert {(r["conv_id"], r["turn"]): (r["prompt"], r["n_tokens"]) for r in rows} == {k: (text[k], n) for k, n in size.items() if n <= 60}


def test_files_are_written_by_name(spark, tmp_path):
    from trajectra.sources import sinks

    rows = spark.createDataFrame([("a.png", bytearray(b"\x01\x02")), ("b.png", None)], "name string, content binary")
    got = {r["name"]: r["path"] for r in sinks.write_files(rows, f"file://{tmp_path}/pictures", "name", "content").collect()}
    assert got == {n: f"file://{tmp_path}/pictures/{n}" for n in ("a.png", "b.png")}
    assert (tmp_path / "pictures/a.png").read_bytes() == b"\x01\x02" and (tmp_path / "pictures/b.png").read_bytes() == b""
