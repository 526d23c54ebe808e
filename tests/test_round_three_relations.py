"""Relations of duties: rows travel once, and the quick ways of reading words and modality give what the patterns give."""

import os
import re

import pytest
from normlake.functions import text as tx
from normlake.operators import documents as dc
from normlake.plans.analysis import jon14_strongest
from normlake.plans.reading import jon16_candidates
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_duties_and_statements_travel_once(spark):
    plan = jon14_strongest(spark, SF_DIR)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 2


def test_words_and_modality(spark):
    texts = ["The firm MUST not Report", "Islak İZİN ıspanak", "INDEX of İt", "naïve œuvre must", "must5 xmust mustx", "you İmust", "Shall\nnot may not", "should nots", "MAY keep", "smay", "", None, "mayK", "a1bc defg-hijk"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in rows.select("i", tx.words(F.col("t"), 4).alias("w"), dc.modality(F.col("t")).alias("m")).collect()}
    patterns = [("(?i)(must|shall) not", "MUST_NOT"), ("(?i)(^|[^a-z])(must|shall)([^a-z]|$)", "MUST"), ("(?i)should not", "SHOULD_NOT"),
                ("(?i)(^|[^a-z])should([^a-z]|$)", "SHOULD"), ("(?i)may not", "MAY_NOT"), ("(?i)(^|[^a-z])may([^a-z]|$)", "MAY")]
    for i, t in enumerate(texts):
        assert got[i].m == (None if t is None else next((m for p, m in patterns if re.search(p, t, re.ASCII)), None))
        assert got[i].w == (None if t is None else re.findall(f"[{tx.LETTERS}]{{4,}}", t.translate(str.maketrans(tx.FOLD_FROM, tx.FOLD_TO)).lower()))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_each_channel_is_scored_once(spark):
    plan = jon16_candidates(spark, SF_DIR)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert len(re.findall("FlatMapCoGroupsInPandas", plan)) == 2
