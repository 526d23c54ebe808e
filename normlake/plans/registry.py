"""Registry of named queries: the Spark callable and, where SQL can say it, the equivalent SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, *operators: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``; ``operators`` are the inventory ids it answers for."""

    def keep(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, operators)
        return fn

    return keep
