import os
import re

import duckdb
import pytest

import corpus_pipeline
from foliant.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("lang", "keep")
    first, names = docs, docs.columns
    kept = {r.doc_id for r in docs.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        if name == "packing":
            break
        assert docs.columns == names, name
        now = {r.doc_id for r in rows}
        assert now <= kept and len(now) == len(rows), name
        if name == "exact_dedup":
            alive = {i: re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]) for i in kept}
            assert now == {min(i for i, t in alive.items() if t == u) for u in set(alive.values())}
        kept = now
        docs = spark.createDataFrame(rows, docs.schema)
    assert {r.doc_id for r in rows} == kept
    # where rests are cut depends on the partitions; what is packed does not
    tokens = lambda found: {(r.doc_id, r.doc_tokens) for r in found}
    assert tokens(corpus_pipeline.run(spark, SF).collect()) == tokens(rows)
    assert first.count() > len(kept)


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b", None, "s", 3), (None, "a b", "x", "s", 3), (3, "x" * 9000, "en", None, 9000)], "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.limit(0)):
        now = df
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
            if name != "packing":
                assert now.columns == docs.columns
        assert (now.count() > 0) == (df is docs)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = con.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    want = sorted((tuple(x[k] for k in at) for x in r.fetchall()), key=repr)
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == want
