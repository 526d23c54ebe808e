"""Blocked scans equal plain windows, with one key holding most of the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from normlake.functions import scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i, rng.randrange(9), None if rng.random() < 0.5 else rng.randrange(100))
            for i in range(600)]
    return spark.createDataFrame(data, "k string, at bigint, v bigint, maybe bigint").withColumn("block", F.floor(F.col("at") / 37))


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_row_number(rows):
    w = Window.partitionBy("k").orderBy("at")
    same(scan.row_number(rows, ["k"], "block", [F.col("at")], "n").select("k", "at", "n"),
         rows.withColumn("n", F.row_number().over(w)).select("k", "at", "n"))


def test_running_sum(rows):
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    same(scan.running_sum(rows, ["k"], "block", [F.col("at")], "v", "n").select("k", "at", "n"),
         rows.withColumn("n", F.sum("v").over(w)).select("k", "at", "n"))


def test_previous(rows):
    w = Window.partitionBy("k").orderBy("at")
    same(scan.previous(rows, ["k"], "block", [F.col("at")], "v", "n").select("k", "at", "n"),
         rows.withColumn("n", F.lag("v").over(w)).select("k", "at", "n"))


def test_carry_forward(rows):
    w = Window.partitionBy("k").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    same(scan.carry_forward(rows, ["k"], "block", [F.col("at")], "maybe", "n").select("k", "at", "n"),
         rows.withColumn("n", F.last("maybe", ignorenulls=True).over(w)).select("k", "at", "n"))
