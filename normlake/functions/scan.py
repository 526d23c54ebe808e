"""Ordered scans that do not put one key into one task.

A plain ``Window.partitionBy(key)`` sorts the whole key in a single task, so a key that holds a third of the rows
becomes the job. Each function here takes a ``block`` column that follows the order (a month of the timestamp, a line
number divided by a constant): the scan runs inside (key, block), the blocks are summarised to one row each, the small
summary is scanned per key and joined back. One shuffle of the rows on (key, block); the summary is one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: list[str], block: str):
    return Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)


def _attach(df: DataFrame, summary: DataFrame, on: list[str]) -> DataFrame:
    """Joins the block summary back; a key that is NULL keeps its rows."""
    side = summary.select(*[F.col(c).alias(f"_on_{c}") for c in on], *[c for c in summary.columns if c not in on])
    condition = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_on_{c}"))
        condition = same if condition is None else condition & same
    return df.join(side, condition).drop(*[f"_on_{c}" for c in on])


def _inside(keys: list[str], block: str, order: list[Column]):
    return Window.partitionBy(*keys, block).orderBy(*order)


def row_number(df: DataFrame, keys: list[str], block: str, order: list[Column], out: str) -> DataFrame:
    """Gap-free 1-based position of every row inside its key."""
    sizes = df.groupBy(*keys, block).agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(_before(keys, block)), F.lit(0))).drop("_size")
    placed = _attach(df, starts, [*keys, block])
    return placed.withColumn(out, (F.col("_start") + F.row_number().over(_inside(keys, block, order))).cast("bigint")).drop("_start")


def running_sum(df: DataFrame, keys: list[str], block: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of ``value`` up to and including the row."""
    totals = df.groupBy(*keys, block).agg(F.sum(value).alias("_total"))
    starts = totals.withColumn("_start", F.coalesce(F.sum("_total").over(_before(keys, block)), F.lit(0))).drop("_total")
    window = _inside(keys, block, order).rowsBetween(Window.unboundedPreceding, 0)
    return _attach(df, starts, [*keys, block]).withColumn(out, F.col("_start") + F.sum(value).over(window)).drop("_start")


def previous(df: DataFrame, keys: list[str], block: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Value of the row before, across block borders (NULL on the first row of a key). ``value`` must not be NULL."""
    tail = df.groupBy(*keys, block).agg(F.max_by(value, F.struct(*order)).alias("_tail"))
    borders = tail.withColumn("_border", F.lag("_tail").over(Window.partitionBy(*keys).orderBy(block))).drop("_tail")
    inside = F.lag(value).over(_inside(keys, block, order))
    return _attach(df, borders, [*keys, block]).withColumn(out, F.coalesce(inside, F.col("_border"))).drop("_border")


def carry_forward(df: DataFrame, keys: list[str], block: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Last non-NULL ``value`` at or before the row (heading carry, sticky states)."""
    tail = df.groupBy(*keys, block).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_tail"))
    borders = tail.withColumn("_border", F.last("_tail", ignorenulls=True).over(_before(keys, block))).drop("_tail")
    window = _inside(keys, block, order).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(value, ignorenulls=True).over(window)
    return _attach(df, borders, [*keys, block]).withColumn(out, F.coalesce(inside, F.col("_border"))).drop("_border")
