import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from meridian.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, oracle, name):
    rel = oracle.execute(catalog.ORACLES[name])
    cols = [d[0] for d in rel.description]
    want = sorted(map(repr, rel.fetchall()))
    df = catalog.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == want


def test_recall(spark):
    r = catalog.QUERIES["ann_recall"](spark, SF).first()
    assert r["recall"] >= 0.95 and r["total"] == 50
    assert all(x["violations"] == 0 for x in catalog.QUERIES["hnsw_degree_stats"](spark, SF).collect())


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


def test_without_the_corpus_subpackage(monkeypatch):
    for name in ("corpus_pipeline", "meridian.llm", "meridian.llm.queries"):
        monkeypatch.setitem(sys.modules, name, None)
    again = importlib.reload(entry)
    try:
        assert set(again.queries()) == set(catalog.QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
