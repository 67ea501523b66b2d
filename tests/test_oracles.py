import pytest
from compare import DATA, oracle_rows, spark_rows

from markwright.plans.registry import ORACLES, QUERIES

SF = "sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    names, rows = spark_rows(QUERIES[name](spark, str(DATA / SF)))
    assert rows
    if name in ORACLES:
        want_names, want = oracle_rows(ORACLES[name], SF)
        assert names == want_names
        assert rows == want


def test_entry_imports_without_llm(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "markwright.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) == set(ORACLES)
