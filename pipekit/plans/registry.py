"""Registered queries: a Spark query and, where SQL can express it, the SQL it must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pipekit.sources.tables import read_table

QueryFunction = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFunction] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the tables of a directory."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.directory, name)


def fresh_name(tag: str) -> str:
    """A catalog name that no other run uses."""
    return f"pipekit_{tag}_{uuid.uuid4().hex}"


def register(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], QueryFunction]:
    """Registers ``build(tables)`` as the query of that name, with its SQL."""

    def decorate(build: Callable[[Tables], DataFrame]) -> QueryFunction:
        def run(spark: SparkSession, directory: str) -> DataFrame:
            return build(Tables(spark, directory))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return decorate
