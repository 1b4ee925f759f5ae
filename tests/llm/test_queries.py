import pytest
from oracle import compare, connect

import corpus_pipeline
from lmprep.llm.queries import ORACLES, QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, con, name):
    result = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert result["ok"] is not False, (result["rows"], result["want"], result["types"])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_every_row(spark, name):
    df = QUERIES[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.select("doc_id").distinct().count() == n and (name == "op9_best_fit" or df.count() == n)


def test_pipeline_stage_by_stage(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = source, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == source.columns
        seen[name] = (docs, out)
        docs = corpus_pipeline.written(out, "test")
    before, after = seen["near_duplicates"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == set(brute.components(texts).values())
    before, after = seen["secret_scan"]
    assert before.count() == after.count() and not any(brute.secrets(r.text) for r in after.collect())
    assert all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["best_fit_packing"]
    assert {r.doc_id for r in before.collect()} == {r.doc_id for r in after.collect()}
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
