"""Expectations on streams: the same failure predicate as in batch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from pipekit.operators.rules import QualityRule, expect_or_drop, expect_or_fail, tag_failures
from pipekit.streaming.ingest import run_available

METRICS_NAME = "expectations"


def expect_stream(stream: DataFrame, rules: Sequence[QualityRule], on_violation: str = "drop") -> DataFrame:
    """``drop`` the rows that break a rule, ``flag`` them in ``_failed_rules``, or ``fail`` the query.

    Counters per rule are observed on the way, without another pass; read them with
    :func:`stream_metrics`.
    """
    observed = stream.observe(METRICS_NAME, *_counters(rules))
    return _handled(observed, rules, on_violation)


def _counters(rules: Sequence[QualityRule]) -> list[Column]:
    return [F.count(F.lit(1)).alias("total_records"), *[F.count_if(r.failure).alias(f"failed_{r.name}") for r in rules]]


def _handled(observed: DataFrame, rules: Sequence[QualityRule], on_violation: str) -> DataFrame:
    if on_violation == "drop":
        return expect_or_drop(observed, rules)
    if on_violation == "flag":
        return tag_failures(observed, rules)
    if on_violation == "fail":
        return expect_or_fail(observed, rules)
    raise ValueError(f"on_violation must be drop, flag or fail, not {on_violation!r}")


def stream_metrics(query: StreamingQuery) -> dict[str, int]:
    """Counters summed over all micro-batches.  The query remembers a limited number of them
    (``spark.sql.streaming.numRecentProgressUpdates``); if any is gone this raises instead of counting less:
    :class:`CountedBatches` keeps its counters in files."""
    totals: dict[str, int] = {}
    remembered = query.recentProgress
    ids = {progress.batchId for progress in remembered}
    if missing := set(range(max(ids, default=-1) + 1)) - ids:
        raise RuntimeError(f"{len(missing)} micro-batches are no longer remembered, the first is {min(missing)}")
    for progress in remembered:
        row = progress.observedMetrics.get(METRICS_NAME)
        for name, value in (row.asDict() if row else {}).items():
            totals[name] = totals.get(name, 0) + value
    return totals


@dataclass(frozen=True)
class CountedBatches:
    """Writes a stream under expectations, with counters that outlive the query and any number of batches.

    Batch n goes to ``data/batch=n`` and its counters, one row, to ``counters/batch=n``; both are counted and written in one
    pass over the batch.  A batch that is run again after a crash overwrites both, so nothing counts twice.
    """

    spark: SparkSession
    root: str
    rules: Sequence[QualityRule]
    on_violation: str = "drop"

    def write_batch(self, df: DataFrame, batch: int) -> None:
        seen = Observation()
        rows = _handled(df.observe(seen, *_counters(self.rules)), self.rules, self.on_violation)
        rows.write.mode("overwrite").parquet(f"{self.root}/data/batch={batch}")
        counts = df.sparkSession.createDataFrame([tuple(seen.get[name] for name in self._names())], self._schema())
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/counters/batch={batch}")

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Writes everything the stream has now, in as many batches as it takes."""
        return run_available(stream.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint))

    def _names(self) -> list[str]:
        return ["total_records", *[f"failed_{rule.name}" for rule in self.rules]]

    def _schema(self) -> str:
        return ", ".join(f"`{name}` long" for name in self._names())

    def counters(self) -> DataFrame:
        """A row per batch."""
        return self.spark.read.schema(self._schema() + ", batch long").parquet(f"{self.root}/counters")

    def metrics(self) -> DataFrame:
        """A row per rule over all batches: ``rule_name, batches, total_records, failed_records``."""
        totals = self.counters().agg(F.count(F.lit(1)).alias("_batches"), *[F.sum(f"`{n}`").alias(n) for n in self._names()])
        rows = [
            F.struct(
                F.lit(rule.name).alias("rule_name"),
                F.col("_batches").alias("batches"),
                F.col("total_records"),
                F.col(f"`failed_{rule.name}`").alias("failed_records"),
            )
            for rule in self.rules
        ]
        return totals.select(F.inline(F.array(*rows)))
