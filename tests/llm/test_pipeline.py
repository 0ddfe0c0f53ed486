import duckdb
import pytest

import corpus_pipeline
from kinfold.llm import sql
from kinfold.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    ids = [{r.doc_id for r in docs.select("doc_id").collect()}]
    texts = {r.doc_id: r.text for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, FOLDER)
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert ids[-1] <= ids[-2], name
        if name != "tokens":
            assert docs.schema.names == before.schema.names
    assert len(ids[1]) >= len(ids[0]) - 2
    assert not any(b in texts[i] for i in ids[3] for b in bench) and all(any(b in texts[i] for b in bench) for i in ids[2] - ids[3])
    assert ids[4] == ids[3] == ids[5]
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == ids[-1]


def test_near_dedup_of_repeated_and_null_ids(spark):
    copied, clean, lone = (" ".join(f"{w}{i}" for i in range(40)) for w in ("copied", "clean", "lone"))
    rows = [(1, copied), (7, copied + " more"), (7, clean), (8, lone), (8, lone), (None, copied), (None, "too short"), (None, "too short"), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string")
    got = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert got.columns == docs.columns
    want = [(1, copied), (7, clean), (8, lone), (None, "too short"), (None, None)]
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    want = con.sql(sql.ORACLES[name]).df()
    got = queries()[name](spark, FOLDER).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
