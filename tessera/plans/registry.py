"""A registry of queries with their operator ids and, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    operators: str
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(operators: str, sql: str | None = None):
    """Registers a query under its function's name; ``operators``: ids of the survey's inventory."""

    def add(f: Query) -> Query:
        ENTRIES[f.__name__] = Entry(f, operators, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
