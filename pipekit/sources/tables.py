"""Named-table scans, incremental reads and parameterised extracts."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One parquet table of a directory of tables."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def since(df: DataFrame, watermark_column: str, last_value: Any, inclusive: bool = False) -> DataFrame:
    """Rows past the high-water mark.

    The mark is a typed literal compared with the bare column, so the filter is pushed into the parquet
    row groups or the database.  It is cast to the column's type; never the column to the mark's.  Strict
    by default; ``inclusive`` re-reads rows that share the mark, for pipelines that upsert by key.
    """
    if last_value is None:
        return df
    kind = df.schema[watermark_column].dataType
    if isinstance(last_value, datetime) and isinstance(kind, T.TimestampNTZType):
        last_value = str(last_value)  # a time without zone must not pass through the zone of this machine
    mark = (last_value if isinstance(last_value, Column) else F.lit(last_value)).cast(kind)
    column = F.col(watermark_column)
    return df.filter(column >= mark if inclusive else column > mark)


def parameterized(
    spark: SparkSession, query: str, params: Mapping[str, Any] | None = None, **views: DataFrame
) -> DataFrame:
    """SQL text with bound ``:name`` markers, over frames named in the text as ``{name}``."""
    return spark.sql(query, args=dict(params or {}), **views)


def first_row(df: DataFrame) -> DataFrame:
    """A single row of the frame; scans no more partitions than it takes to find one."""
    return df.limit(1)


@dataclass(frozen=True)
class TableSource:
    """Reads catalog tables; the simplest thing that satisfies :class:`pipekit.protocols.Source`."""

    spark: SparkSession

    def read_table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def read_incremental(self, name: str, watermark_column: str, last_value: Any, inclusive: bool = False) -> DataFrame:
        return since(self.read_table(name), watermark_column, last_value, inclusive)
