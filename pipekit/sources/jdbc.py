"""Database reads through Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from pipekit.sources.tables import since


# The URL forms that the two drivers expect.


def oracle_url(host: str, port: int, service_name: str) -> str:
    return f"jdbc:oracle:thin:@{host}:{port}:{service_name}"


def sqlserver_url(server: str, database: str) -> str:
    return f"jdbc:sqlserver://{server};databaseName={database}"


def range_predicates(column: str, cuts: Sequence[Any]) -> list[str]:
    """WHERE clauses that cut a table into ranges; together they select every row exactly once.

    Equal-width strides (``partitionColumn``) give one connection most of the rows when the column is
    skewed; cut points taken from the data do not.  NULLs go with the first range.
    """
    if not cuts:
        return ["1 = 1"]
    quoted = [str(cut) if isinstance(cut, (int, float)) else "'" + str(cut).replace("'", "''") + "'" for cut in cuts]
    ranges = [f"{column} < {quoted[0]} OR {column} IS NULL"]
    ranges += [f"{column} >= {low} AND {column} < {high}" for low, high in zip(quoted, quoted[1:])]
    return [*ranges, f"{column} >= {quoted[-1]}"]


@dataclass(frozen=True)
class JdbcSource:
    """A database.  Reads stay lazy frames, so filters and column choices are pushed to the server."""

    spark: SparkSession
    url: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    fetch_size: int | None = 10_000
    extra: Mapping[str, str] = field(default_factory=dict)

    def options(self, **more: Any) -> dict[str, str]:
        """Reader options; unset ones are left out."""
        given = {"url": self.url, "user": self.user, "password": self.password, "fetchsize": self.fetch_size}
        merged = {**given, **self.extra, **more}
        return {key: str(value) for key, value in merged.items() if value is not None}

    def read_table(self, name: str) -> DataFrame:
        """Whole table over one connection."""
        return self.spark.read.format("jdbc").options(**self.options(dbtable=name)).load()

    def read_partitioned(self, name: str, column: str, lower: Any, upper: Any, partitions: int) -> DataFrame:
        """Whole table over ``partitions`` connections, split by equal strides of a numeric or time column.
        The bounds only place the strides: rows outside them are read by the outermost partitions."""
        split = {"partitionColumn": column, "lowerBound": lower, "upperBound": upper, "numPartitions": partitions}
        return self.spark.read.format("jdbc").options(**self.options(dbtable=name, **split)).load()

    def read_ranges(self, name: str, column: str, cuts: Sequence[Any]) -> DataFrame:
        """Whole table, one connection per range between the cut points (for skewed columns)."""
        properties = {key: value for key, value in self.options().items() if key != "url"}
        return self.spark.read.jdbc(
            self.url, name, predicates=range_predicates(column, cuts), properties=properties
        )

    def read_incremental(self, name: str, watermark_column: str, last_value: Any, inclusive: bool = False) -> DataFrame:
        """Rows past the mark: a typed filter that Spark pushes to the server, never pasted text."""
        return since(self.read_table(name), watermark_column, last_value, inclusive)

    def extract(self, query: str) -> DataFrame:
        """Result of a query that the server runs."""
        return self.spark.read.format("jdbc").options(**self.options(query=query)).load()
