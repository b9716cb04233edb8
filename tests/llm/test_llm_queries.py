"""Registered queries against their SQL on the smallest folder, and the pipeline against its parts."""

import os

import pytest
from compare import connect, differences

import corpus_pipeline
from tariffmill.llm.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert differences(queries()[name](spark, FOLDER), duck, oracle_sql()[name]) == []


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns, name
        assert docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.select("doc_id").distinct().count() == before


def test_native_plans_hold_no_python(spark):
    for name in ("op7_exact_dedup", "op10_quality"):
        plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_awkward_rows(spark, documents, awkward, tmp_path, empty):
    """Nulls, blanks, repeated rows and ids, a long text and columns of clashing names; and a table without rows."""
    rows = [] if empty else awkward + [(20 + i, awkward[4][1][i:] + " end.") for i in range(3)] + [(None, awkward[4][1]), (4, awkward[4][1])]
    docs = documents(rows)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.schema(out.schema).parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
            texts = [r.text for r in docs.select("text").collect()]
        if name == "exact_dedup":
            assert len(texts) == len(set(texts))
    assert bool(texts) is not empty
    assert docs.count() >= len(texts)
