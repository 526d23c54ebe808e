"""Readers over Arrow batches give the rows of the lateral table functions and read equal texts once."""

import uuid

from pyspark.sql import functions as F

from normlake.functions import numerals as nm
from normlake.operators import readers as rd

TEXTS = ("A bank must keep the records for 7 years where the customer is a consumer.", "Bankalar on iş günü içinde bildirmek zorundadır.", "No duty here.", "", None)


def test_equal_texts_are_read_once(spark, monkeypatch):
    class Stamped:
        """A row with a mark of its own for every call."""

        def eval(self, text: str):
            if text:
                yield 0, uuid.uuid4().hex

    monkeypatch.setitem(rd.TABLE_FUNCTIONS, "stamped", (Stamped, "seq int, mark string"))
    df = spark.range(0, 5000, 1, 16).select("id", F.element_at(F.array(*map(F.lit, TEXTS)), (F.col("id") % 5 + 1).cast("int")).alias("text"))
    got = rd.laterally(df, "stamped", "text", repeated=True).groupBy("text").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("mark").alias("marks")).collect()
    assert {(r.text, r.n, r.marks) for r in got} == {(t, 1000, 1) for t in TEXTS[:3]}


def test_rows_are_those_of_the_lateral_functions(spark):
    rd.register(spark)
    df = spark.createDataFrame([(n, TEXTS[n % 5], "art. 1", [TEXTS[0]]) for n in range(40)], "row int, text string, label string, spans array<string>")
    df.createOrReplaceTempView("reader_texts")
    for name, columns in (("read_quantities", ["text"]), ("duty_markers", ["text"]), ("read_duties", ["text"]), ("duty_elements", ["text"]), ("reading_units", ["text", "label"]),
                          ("split_clauses", ["text", "label"]), ("missing_qualifiers", ["text", "spans"]), ("uncovered_sentences", ["text", "spans"])):
        want = spark.sql(f"SELECT * FROM reader_texts t, LATERAL {name}({', '.join('t.' + c for c in columns)})")
        for repeated in (False, True):
            got = rd.laterally(df, name, *columns, repeated=repeated)
            assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), name


def test_words_that_begin_no_number_are_passed():
    assert nm.may_begin("Twenty") and nm.may_begin("7") and nm.may_begin("Yüzseksenbeşbin") and nm.may_begin("$") and not nm.may_begin("records")
    assert [q.text for q in nm.read_quantities("İki buçuk yıl, twenty-four hours and EUR 15,000")] == ["İki buçuk yıl", "twenty-four hours", "EUR 15,000"]


def test_only_kept_columns_are_handed_on(spark):
    df = spark.createDataFrame([(n, TEXTS[n % 5]) for n in range(10)], "row int, text string")
    whole = rd.laterally(df, "read_duties", "text")
    kept = rd.laterally(df, "read_duties", "text", repeated=True, keep=("row",))
    assert kept.columns == [c for c in whole.columns if c != "text"]
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, whole.drop("text").collect()))
