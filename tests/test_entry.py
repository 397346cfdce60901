"""The registry loads whatever is installed beside the claim library."""

import sys

import __spark_entry__ as E


def test_registry_survives_a_missing_package(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("claimlens.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    names, sql = set(E.queries()), set(E.oracle_sql())
    assert len(names) > 100 and sql <= names
    assert not any(n.startswith("op1_") or n == "pipeline" for n in names)


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
