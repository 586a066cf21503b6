"""A registry of named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import letter_hash_sql


@dataclass(frozen=True)
class Tables:
    """The tables of one folder, read as they are asked for."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


LETTER_HASH = f"h AS (SELECT doc_id, {letter_hash_sql('coalesce(text, chr(32))')} AS bits FROM documents)"  # a common table of SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its SQL where there is one."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add
