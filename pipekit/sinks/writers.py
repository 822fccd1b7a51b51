"""Plain writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from pipekit.sinks.store import TableStore

MODES = ("overwrite", "append", "errorifexists", "ignore")


def _writer(df: DataFrame, mode: str, partition_by: Sequence[str], options: Mapping[str, str]):
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    writer = rows.write.format("parquet").mode(mode).options(**options)
    return writer.partitionBy(*partition_by) if partition_by else writer


@dataclass(frozen=True)
class TableWriter:
    """Writes catalog tables.  With ``evolve`` an append may bring new columns, which are added to the table, and leave
    out others, which are NULL in its rows; without it the columns must agree."""

    partition_by: Sequence[str] = ()
    options: Mapping[str, str] = field(default_factory=dict)
    evolve: bool = False

    def write(self, df: DataFrame, destination: str, mode: str = "overwrite") -> None:
        if self.evolve and mode == "append" and df.sparkSession.catalog.tableExists(destination):
            TableStore(df.sparkSession).append_evolving(df, destination)
            return
        _writer(df, mode, self.partition_by, self.options).saveAsTable(destination)


@dataclass(frozen=True)
class PathWriter:
    """Writes directories below a base path."""

    base: str
    partition_by: Sequence[str] = ()
    options: Mapping[str, str] = field(default_factory=dict)

    def write(self, df: DataFrame, destination: str, mode: str = "overwrite") -> None:
        _writer(df, mode, self.partition_by, self.options).save(f"{self.base}/{destination}")


def create_if_absent(df: DataFrame, name: str, partition_by: Sequence[str] = (), **options: str) -> bool:
    """Creates the table from the frame unless it exists; tells whether it did.  An existing table is never
    overwritten, also not when another job creates it in between."""
    if df.sparkSession.catalog.tableExists(name):
        return False
    TableWriter(partition_by, options).write(df, name, mode="errorifexists")
    return True


def create_from_query(
    spark: SparkSession, query: str, name: str, partition_by: Sequence[str] = (), **options: str
) -> None:
    """Creates a table from the result of a query."""
    TableWriter(partition_by, options).write(spark.sql(query), name, mode="errorifexists")
