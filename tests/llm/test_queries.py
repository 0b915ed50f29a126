import duckdb
import pytest

import corpus_pipeline
from ledgerline.llm import common
from ledgerline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    found = QUERIES[name](spark, SF)
    with duckdb.connect() as db:
        for t in ("documents", "embeddings", "labels"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        wanted = db.sql(ORACLES[name])
        assert sorted(found.columns) == sorted(wanted.columns)
        columns = sorted(found.columns)
        rows = wanted.select(*(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(str, map(tuple, found.select(columns).collect()))) == sorted(map(str, rows))


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    docs = common.documents(spark, SF)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = common.staged(stage(spark, docs, SF))
        assert docs.columns == before.columns, name
        if name != "mixing":
            assert docs.subtract(before).isEmpty(), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
    assert sorted(map(str, last.collect())) == sorted(map(str, corpus_pipeline.run(spark, SF).collect()))
