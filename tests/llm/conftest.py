"""Rows that every operator must take: nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""

import pytest

LONG = " ".join(f"w{i % 977}" for i in range(20_000))
ODD = [
    (1, "one two three four five six", "en", "src0"),
    (1, "one two three four five six", "en", "src0"),
    (2, None, None, None),
    (3, "", "en", "src1"),
    (4, " \t\n ", "de", None),
    (5, LONG, "de", "src0"),
    (6, LONG, "de", "src0"),
    (None, "one two three four five six", "en", "src1"),
    (None, None, None, None),
    (-7, "Ünïcode   words 日本語 \U0001f642 here", "fr", "src0"),
]
#: Names that operators use inside, as further columns of the input.
CLASHING = ("chunk", "row", "rep", "name", "share", "kind", "first", "last", "words", "spans", "ids", "host", "path", "evidence", "region", "class_id", "kept", "training", "label",
            "features", "score", "_kept_id", "_words", "body", "hits", "original")


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.selectExpr("*", *[f"'x' AS `{name}`" for name in CLASHING]) if clash else df


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
