import random

from conftest_llm import ODD, frame
from normlake.llm.quality import judge, keep_good, site_posteriors
from pyspark.sql import functions as F


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def corpus(n, seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioutrnsl") for _ in range(r.randint(2, 8))) for _ in range(900)]
    rows, verdicts = [], []
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(80)]
        kind = i % 5
        if kind == 1:
            w = [x.upper() + "!!" for x in w]
        if kind == 2:
            for _ in range(4):
                w[r.randrange(80)] = r.choice(["vilething", "foulname", "nastyword"])
        rows.append((i, " ".join(w), r.choice(["en", "de"]), "big" if i % 3 else f"s{i % 11}"))
        verdicts.append((i, int(kind != 1), int(kind == 2)))
    return rows, verdicts


def test_held_out_accuracy(spark):
    rows, verdicts = corpus(600)
    got = {r.doc_id: r.kept for r in judge(frame(spark, rows), labels(spark, verdicts[:400])).collect()}
    right = sum(got[i] == (q == 1 and t == 0) for i, q, t in verdicts[400:])
    assert right >= 195, right


def test_odd_rows_and_labels(spark, odd, nothing):
    bad = labels(spark, [(1, None, None), (None, 1, 0), (2, 0, None), (3, 1, 0), (3, 0, 0), (99, 1, 1)])
    assert sorted(str(r.doc_id) for r in judge(odd, bad).collect()) == sorted(str(r[0]) for r in ODD)
    unlabelled = judge(odd, labels(spark, [])).collect()
    assert len(unlabelled) == len(ODD) and all(r.kept for r in unlabelled)
    assert judge(nothing, bad).collect() == []
    assert keep_good(odd, labels(spark, [])).columns == odd.columns


def test_sparse_sites_keep_close_to_their_prior(spark):
    scored = spark.range(4000).select(F.when(F.col("id") < 3998, F.concat(F.lit("h"), F.col("id") % 4)).otherwise(F.lit("tiny")).alias("host"), F.lit("p").alias("path"),
                                      F.when((F.col("id") % 4 == 0) | (F.col("id") >= 3998), -5.0).otherwise(5.0).alias("evidence"))
    sites, whole = site_posteriors(scored)
    share = {r.host: r.share for r in sites.collect()}
    assert share["h0"] < 0.1 < whole < share["h1"] and share["h0"] < share["tiny"] < whole
