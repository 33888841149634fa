import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_keep_columns_and_take_effect(spark):
    import corpus_pipeline as p
    from tickloom.llm import minhash
    from tickloom.llm.common import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    docs = docs.unionByName(docs.limit(3))  # repeated rows
    for name, stage in p.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF))
        assert docs.columns == columns, name
        if name == "near_dedup":
            assert docs.select("doc_id").distinct().count() == docs.count()
    marked = minhash.near_duplicates(docs, 5, 0.8)
    assert 0 < docs.count() < before and marked.where("NOT kept").count() == 0
    packed = p.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed.doc_id) == {r[0] for r in docs.select("doc_id").collect()}


def test_sql_of_queries(spark):
    import duckdb

    from tickloom.llm import queries

    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, SF).toPandas(), duck.sql(sql).df()
        assert sorted(map(str, got[sorted(got)].values.tolist())) == sorted(map(str, want[sorted(got)].values.tolist()))
