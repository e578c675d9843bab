import pytest

import __spark_entry__ as entry
from quillstone.plans import catalog
from tests.oracle import compare


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "score"] and df.count() == 10


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, small, name):
    compare(spark, small, catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_has_rows(spark, small, name):
    assert catalog.QUERIES[name](spark, small).limit(1).count() == 1


def test_queries_without_the_optional_subpackage(monkeypatch):
    real = entry._optional
    monkeypatch.setattr(entry, "_optional", lambda n: None if "llm" in n or n == "corpus_pipeline" else real(n))
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.ORACLES)


def test_only_a_missing_module_is_forgiven(monkeypatch):
    assert entry._optional("quillstone.nothing_of_the_kind") is None

    def broken(name):
        raise ModuleNotFoundError("no numpy", name="numpy")

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry._optional("quillstone.llm.registry")
