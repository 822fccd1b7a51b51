"""Change-feed apply: newest change per key, upserts and deletes into a versioned target."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from pipekit.operators.merge import MergeRule, upsert
from pipekit.streaming.ingest import run_available


@dataclass(frozen=True)
class ChangeApplier:
    """Applies micro-batches of changes; batch n turns version n-1 of the target into version n.

    A version is a directory named after its batch.  If a batch is replayed after a crash it reads the same
    version n-1 and writes version n again, so the effect is exactly once.  Version -1 is the initial
    target.  A finished version is noted in the folder ``applied``, a replayed one in the same place.  The cost of a batch
    is a rewrite of the target: for batches far smaller than it use :class:`pipekit.sinks.ChangeLogTable`.
    """

    root: str
    schema: T.StructType
    rule: MergeRule

    def version(self, batch_id: int) -> str:
        return f"{self.root}/batch={batch_id}"

    def start_from(self, target: DataFrame) -> None:
        target.write.mode("errorifexists").parquet(self.version(-1))
        self._note(target.sparkSession, -1)

    def _note(self, spark: SparkSession, batch_id: int) -> None:
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/applied/batch={batch_id}")

    def apply(self, changes: DataFrame, batch_id: int) -> None:
        before = changes.sparkSession.read.schema(self.schema).parquet(self.version(batch_id - 1))
        changes.persist()  # the merge reads its changes more than once
        try:
            upsert(before, changes, self.rule).write.mode("overwrite").parquet(self.version(batch_id))
        finally:
            changes.unpersist()
        self._note(changes.sparkSession, batch_id)

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return run_available(writer)

    def current(self, spark: SparkSession) -> DataFrame:
        """The last finished version (the initial target before the first batch)."""
        noted = spark.read.schema("id long, batch long").parquet(f"{self.root}/applied")
        return spark.read.schema(self.schema).parquet(self.version(noted.agg(F.max("batch")).head()[0]))
