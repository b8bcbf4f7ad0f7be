"""Registered queries of the document index against their SQL twins."""

import os

import duckdb
import pytest

from foliant import catalogue_files as catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    r = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(x[names.index(c)] for c in cols) for x in r.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("missing", ["foliant.llm", "corpus_pipeline", "a_library"])
def test_entry_survives_without_optional_parts(monkeypatch, recwarn, missing):
    import importlib

    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())

    def absent(name):
        raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)

    monkeypatch.setattr(importlib, "import_module", absent)
    assert set(e.queries()) == set(catalogue.QUERIES) and set(e.oracle_sql()) == set(catalogue.ORACLE_SQL)
    assert any("a_library" in str(w.message) for w in recwarn) == (missing == "a_library")
