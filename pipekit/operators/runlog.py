"""Run-log analysis: reliability, recovery time, cost, duration regressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pipekit.functions import added, exact_sums, rate
from pipekit.operators.percentiles import exact_percentiles


def run_reliability(runs: DataFrame, by: Sequence[str], ok: Column) -> DataFrame:
    """Runs, successes and success rate per group."""
    succeeded = F.coalesce(ok, F.lit(False))
    counted = runs.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), F.count_if(succeeded).alias("succeeded"))
    return counted.withColumn("success_rate", rate(F.col("succeeded"), F.col("runs")))


def recovery_time(
    runs: DataFrame, pipeline: str, time_column: str, ok: Column, tie_breaker: str, slices: int | None = None
) -> DataFrame:
    """Per pipeline: failures, how many were followed by a success, and the mean seconds until then.

    Copies of a run are first counted, with partial counts per task.  Then the log is cut into ranges of
    (pipeline, time), so one busy pipeline spreads over many tasks.  Within a slice a running minimum finds
    the next success; a failure without one in its slice takes the first success of a later slice, for
    which a few numbers per pipeline and slice are enough.  Runs without a time are left out.
    """
    spark = runs.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    log = runs.select(
        F.col(pipeline),
        F.unix_micros(F.col(time_column).cast("timestamp")).alias("_us"),
        F.coalesce(ok, F.lit(False)).alias("_ok"),
        F.col(tie_breaker).alias("_tie"),
    ).filter(F.col("_us").isNotNull())
    counted = log.groupBy(pipeline, "_us", "_tie", "_ok").agg(F.count(F.lit(1)).alias("_copies"))
    sliced = counted.repartitionByRange(slices, pipeline, "_us", "_tie").withColumn("_slice", F.spark_partition_id())
    # Newest first, so the frame of later runs grows row by row instead of being recomputed.
    newest_first = W.partitionBy("_slice", pipeline).orderBy(F.col("_us").desc(), F.col("_tie").desc())
    later = newest_first.rowsBetween(W.unboundedPreceding, -1)
    marked = sliced.withColumn("_next", F.min(F.when(F.col("_ok"), F.col("_us"))).over(later))
    failed, closed = ~F.col("_ok"), F.col("_next").isNotNull()

    def copies(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("_copies")).otherwise(0))

    def micros(condition: Column, value: Column) -> Column:
        weighted = value.cast("decimal(20,0)") * F.col("_copies").cast("decimal(12,0)")
        return F.coalesce(F.sum(F.when(condition, weighted)), F.lit(0))

    per_slice = marked.groupBy(pipeline, "_slice").agg(
        copies(failed).alias("failures"),
        copies(failed & closed).alias("_closed"),
        micros(failed & closed, F.col("_next") - F.col("_us")).alias("_closed_us"),
        copies(failed & ~closed).alias("_open"),
        micros(failed & ~closed, F.col("_us")).alias("_open_us"),
        F.min(F.when(F.col("_ok"), F.col("_us"))).alias("_first_ok"),
    )
    later_slices = W.partitionBy(pipeline).orderBy(F.col("_slice").desc()).rowsBetween(W.unboundedPreceding, -1)
    carried = per_slice.withColumn("_carry", F.min("_first_ok").over(later_slices))
    can_close = F.col("_carry").isNotNull()
    waited = F.col("_open").cast("decimal(12,0)") * F.col("_carry").cast("decimal(18,0)") - F.col("_open_us")
    summed = carried.groupBy(pipeline).agg(
        F.sum("failures").alias("failures"),
        (F.sum("_closed") + F.sum(F.when(can_close, F.col("_open")).otherwise(0))).alias("recovered"),
        F.sum(F.col("_closed_us") + F.when(can_close, waited).otherwise(0)).alias("_us"),
    )
    mean = F.try_divide(F.col("_us").cast("double"), F.col("recovered").cast("double")) / 1e6
    return summed.select(pipeline, "failures", "recovered", mean.alias("mttr_seconds"))


def cost_per_unit(runs: DataFrame, by: Sequence[str | Column], cost: str, units: Column) -> DataFrame:
    """Cost, amount processed (an integer) and cost per unit of it, per group (usually a period).  The cost is summed
    exactly and rounded once, so it does not depend on how runs were spread."""
    grouped = exact_sums(runs, by, {"total_cost": F.col(cost)}, {"total_units": added(units)})
    return grouped.withColumn("cost_per_unit", F.try_divide(F.col("total_cost"), F.col("total_units").cast("double")))


def run_durations(
    runs: DataFrame, pipeline: str, period: Column, duration: str, slower_than: float = 1.5
) -> DataFrame:
    """Median and 95th percentile duration per pipeline and period, next to the median of the period
    before (periods are integers), and whether it grew by more than the factor."""
    log = runs.select(pipeline, period.cast("int").alias("period"), duration)
    now = exact_percentiles(log, [pipeline, "period"], duration, {"p50": 0.5, "p95": 0.95})
    before = W.partitionBy(pipeline).orderBy("period")
    # A row per pipeline and period: the previous row counts only if it is the period right before.
    adjacent = F.lag("period").over(before) == F.col("period") - 1
    compared = now.withColumn("previous_p50", F.when(adjacent, F.lag("p50").over(before)))
    slower = F.coalesce(F.col("p50") > F.col("previous_p50") * F.lit(slower_than), F.lit(False))
    return compared.withColumn("regressed", slower)
