import os

import pytest

import corpus_pipeline
from normlake.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == names
            after = {r.doc_id: r.text for r in docs.collect()}
            assert after.keys() <= before.keys() and all(before[i] == t for i, t in after.items())
            before = after
    assert sorted(r.doc_id for r in docs.collect()) == sorted(before)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF_DIR).collect()) == sorted(before)


def test_registered():
    assert [int(n[2:].split("_")[0]) for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)
