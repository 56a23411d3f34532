import pytest

import __spark_entry__ as contract
import corpus_pipeline
from check import compare, connect
from rowloom.llm.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries(spark, db, name):
    verdict, rows = compare(spark, db, name, SF_DIR)
    assert verdict == ("ok" if name in ORACLES else "no sql") and rows > 0


def test_registered():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries())


def test_stages(spark, tmp_path):
    """Each stage keeps the columns, works on what came before and decides as its operator."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF_DIR)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.count()
        assert 0 < after <= before, name
        before = after
    whole = corpus_pipeline.run(spark, SF_DIR)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.select(*whole.columns).collect()))


def test_stages_with_odd_rows(spark, edges, nothing):
    for rows in (edges, nothing):
        docs = rows
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
            assert docs.columns == rows.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() <= rows.count()
