"""Freshness and column statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipekit.functions import rate


def freshness(
    df: DataFrame, time_column: str, max_delay_hours: int, now: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Newest time, whole hours since then, and ``FRESH`` / ``STALE`` / ``UNKNOWN`` (no time at all), for
    the whole frame or per ``by`` group.  Partial maxima keep the shuffle at one row per task and group."""
    now = F.current_timestamp() if now is None else now
    newest = df.groupBy(*by).agg(F.max(time_column).alias("latest"))
    hours = F.timestamp_diff("HOUR", F.col("latest"), now)
    status = F.when(hours.isNull(), "UNKNOWN").when(hours > max_delay_hours, "STALE").otherwise("FRESH")
    return newest.select(*by, "latest", hours.alias("delay_hours"), status.alias("freshness_status"))


def column_stats(df: DataFrame, columns: Sequence[str], exact_distinct: bool = False) -> DataFrame:
    """A row per column: rows, nulls, null rate, smallest and largest value (as text), distinct values.

    Distinct counts come from mergeable sketches in the same scan.  ``exact_distinct`` counts them by a
    second scan that unpivots the columns to (column, value) pairs, combined before the shuffle; the
    alternative, several DISTINCT aggregates in one query, would expand every row per column too and
    carry all other aggregates along.
    """
    aggregates = [F.count(F.lit(1)).alias("_total")]
    for i, name in enumerate(columns):
        aggregates += [
            F.count(F.col(name)).alias(f"_n_{i}"),
            F.min(name).cast("string").alias(f"_min_{i}"),
            F.max(name).cast("string").alias(f"_max_{i}"),
        ]
        if not exact_distinct:
            aggregates.append(F.approx_count_distinct(name).alias(f"_d_{i}"))
    rows = []
    for i, name in enumerate(columns):
        fields = [
            F.lit(name).alias("column_name"),
            F.col("_total").alias("row_count"),
            (F.col("_total") - F.col(f"_n_{i}")).alias("null_count"),
            rate(F.col("_total") - F.col(f"_n_{i}"), F.col("_total")).alias("null_rate"),
            F.col(f"_min_{i}").alias("min_value"),
            F.col(f"_max_{i}").alias("max_value"),
        ]
        if not exact_distinct:
            fields.append(F.col(f"_d_{i}").alias("distinct_count"))
        rows.append(F.struct(*fields))
    stats = df.agg(*aggregates).select(F.inline(F.array(*rows)))
    if not exact_distinct:
        return stats
    pairs = [F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("value")) for n in columns]
    long = df.select(F.inline(F.array(*pairs))).filter(F.col("value").isNotNull()).distinct()
    distinct = long.groupBy("column_name").agg(F.count(F.lit(1)).alias("distinct_count"))
    # Both sides hold one row per column.
    joined = stats.join(distinct, on="column_name", how="left")
    return joined.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("bigint")))
