"""Registered text queries against their SQL, and the pipeline."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from spokeworks.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", list(SQL))
def test_query_matches_sql(spark, name):
    duck = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        duck.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    result = QUERIES[name](spark, FOLDER)
    assert sorted(result.columns) == sorted(names)
    want = sorted(repr(r) for r in found.fetchall())
    assert want and sorted(repr(tuple(r)) for r in result.select(*names).collect()) == want


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and n[:4] not in ("op11", "op12")])
def test_query_returns_every_document(spark, small, name):
    ids = {r.doc_id for r in QUERIES[name](spark, FOLDER).select("doc_id").distinct().collect()}
    assert ids == {r.doc_id for r in small("documents").select("doc_id").collect()}


def test_pipeline_stages(spark, small, hard_docs):
    docs = small("documents")
    mixed = docs.unionByName(hard_docs.select(*docs.columns).withColumn("doc_id", hard_docs["doc_id"] + 10_000))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, mixed, FOLDER)
        if name == "packing":
            assert after.count() >= mixed.count()
        else:
            assert after.columns == docs.columns
            rows = after.persist()
            assert 0 < rows.count() <= mixed.count()
            assert rows.exceptAll(mixed).isEmpty()
            mixed = rows
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
