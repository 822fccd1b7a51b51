"""Stored column sketches: written once per period, merged over any range of periods.

A period's row has the number of rows and values, the least and greatest value, a distinct-count sketch and, for numbers, a
quantile sketch.  A range of periods, or a comparison of two, reads these rows and never the data.  Both sketches are
mergeable: the merge of periods is the sketch of their rows, whatever the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Size of the distinct-count sketch: an error of about 1.04 / sqrt(2**14), below one in a hundred.
DISTINCT_BITS = 14
#: Size of the quantile sketch: rank errors of about one in a thousand.
QUANTILE_K = 2000


def daily_sketches(df: DataFrame, period: Column, columns: Sequence[str]) -> DataFrame:
    """One row per period and column.  Rows are sketched per task before the shuffle."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    aggregates = [F.count(F.lit(1)).alias("_rows")]
    for i, name in enumerate(columns):
        column = F.col(f"`{name}`")
        text = column.cast("string")
        aggregates += [F.count(column).alias(f"_n_{i}"), F.hll_sketch_agg(text, F.lit(DISTINCT_BITS)).alias(f"_d_{i}")]
        if name in numeric:
            value = column.cast("double")
            aggregates += [F.min(value).alias(f"_l_{i}"), F.max(value).alias(f"_h_{i}"), F.kll_sketch_agg_double(value, F.lit(QUANTILE_K)).alias(f"_q_{i}")]
    grouped = df.groupBy(period.alias("period")).agg(*aggregates)

    def of(i: int, name: str) -> Column:
        number = name in numeric
        none = F.lit(None)
        return F.struct(
            F.lit(name).alias("column_name"),
            F.col("_rows").alias("row_count"),
            F.col(f"_n_{i}").alias("value_count"),
            (F.col(f"_l_{i}") if number else none).cast("double").alias("least"),
            (F.col(f"_h_{i}") if number else none).cast("double").alias("greatest"),
            F.col(f"_d_{i}").alias("distinct_sketch"),
            (F.col(f"_q_{i}") if number else none).cast("binary").alias("quantile_sketch"),
        )

    return grouped.select("period", F.inline(F.array(*[of(i, name) for i, name in enumerate(columns)])))


def merged_stats(sketches: DataFrame, quantiles: Sequence[float] = (0.5, 0.95), by: Sequence[str] = ()) -> DataFrame:
    """Statistics of all given periods per column (and ``by``): ``row_count, null_count, distinct_count, least, greatest,
    quantiles`` (an array, NULL for text)."""
    some = F.expr("filter(array(quantile_sketch), q -> q IS NOT NULL)")
    merged = sketches.groupBy("column_name", *by).agg(
        F.sum("row_count").alias("row_count"),
        (F.sum("row_count") - F.sum("value_count")).alias("null_count"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_count"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.kll_merge_agg_double(F.col("quantile_sketch")).alias("_merged"),
    )
    points = F.array(*[F.lit(float(q)) for q in quantiles])
    found = F.when(F.col("greatest").isNotNull(), F.kll_sketch_get_quantile_double(F.col("_merged"), points))
    return merged.withColumn("quantiles", found).drop("_merged")


def drift(sketches: DataFrame, later: Column, limit: float = 0.1) -> DataFrame:
    """Periods where ``later`` holds against the others, per column: distinct values per row and the median on both sides,
    and ``drifted`` where either moved by more than the limit (a fraction)."""
    both = merged_stats(sketches.withColumn("_side", later), [0.5], ["_side"])
    rate, median = F.col("distinct_count") / F.col("row_count"), F.col("quantiles")[0]

    def side(value: Column, late: bool) -> Column:
        return F.max(F.when(F.col("_side") == late, value))

    sides = both.groupBy("column_name").agg(
        side(rate, False).alias("distinct_rate_before"), side(rate, True).alias("distinct_rate"),
        side(median, False).alias("median_before"), side(median, True).alias("median"),
    )

    def moved(now: str, before: str) -> Column:
        return F.coalesce(F.abs(F.col(now) - F.col(before)) > F.abs(F.col(before)) * F.lit(limit), F.lit(False))

    return sides.withColumn("drifted", moved("distinct_rate", "distinct_rate_before") | moved("median", "median_before"))
