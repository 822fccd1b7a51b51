"""One row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipekit.functions import named


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """The newest row of each key; ``order_by`` columns descend, later ones break ties.

    Written as ``row_number() = 1`` so that Spark plans a group limit *before* the shuffle: each task
    sends at most one row per key, and a key that holds a third of the table stays cheap.
    """
    newest_first = [c if isinstance(c, Column) else F.col(c).desc() for c in order_by]
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*newest_first)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def as_of(
    df: DataFrame, keys: Sequence[str], time_column: str, instant: Column, tie_breakers: Sequence[str] = ()
) -> DataFrame:
    """State of a change log at an instant: the newest row per key that is not younger than it."""
    return latest_per_key(df.filter(F.col(time_column) <= instant), keys, [time_column, *tie_breakers])


def unique_or_fail(df: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """The frame itself, one row per key; the job stops where a key occurs twice.

    The check is an aggregation combined before the shuffle, and it sits in a filter: in an unused
    column the optimizer would drop it.
    """
    rest = [column for column in df.columns if column not in keys]
    packed = F.any_value(F.struct(*map(named, rest))).alias("_row") if rest else F.lit(None).alias("_row")
    grouped = df.groupBy(*map(named, keys)).agg(packed, F.count(F.lit(1)).alias("_copies"))
    single = F.when(F.col("_copies") > 1, F.raise_error(F.lit(message))).otherwise(F.lit(True))
    kept = grouped.filter(single.cast("boolean"))
    return kept.select(*[F.col("_row")[c].alias(c) if c in rest else named(c) for c in df.columns])
