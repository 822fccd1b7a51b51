"""Uniqueness of a key across an increment and the table it goes to, without rescanning the table.

A kept table holds the digest of every key, in hash buckets.  An increment is joined with its own buckets of it, so a
duplicate of an old row is found by reading digests of 16 bytes.  Two different keys have one digest with a probability of
about rows squared over 2**129.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipekit.functions import named
from pipekit.operators.expectations import ValidationResult

_SECOND_SEED = 0x5EED


@dataclass(frozen=True)
class UniqueKeyIndex:
    """``root`` is a folder that the whole cluster reaches; NULLs in a key count as equal values.

    ``add`` of the same batch again, after a crash, overwrites what it wrote before."""

    spark: SparkSession
    root: str
    columns: Sequence[str]
    buckets: int = 64

    def _digested(self, df: DataFrame, *more: str) -> DataFrame:
        """``_h1, _h2, bucket`` of each row's key.  A NULL is told from any value, and ('a', 'bc') from ('ab', 'c')."""
        parts: list[Column] = []
        for column in self.columns:
            parts += [named(column).isNull(), named(column)]
        digests = [F.xxhash64(*parts).alias("_h1"), F.xxhash64(F.lit(_SECOND_SEED), *parts).alias("_h2")]
        rows = df.select(*map(named, more), *digests)
        return rows.withColumn("bucket", F.pmod("_h1", F.lit(self.buckets)).cast("int"))

    def _stored(self) -> DataFrame:
        return self.spark.read.schema("_h1 long, _h2 long, batch long, bucket int").parquet(f"{self.root}/digests")

    def create(self) -> None:
        """An index without keys."""
        nothing = self.spark.createDataFrame([], "_h1 long, _h2 long, bucket int")
        nothing.write.mode("errorifexists").partitionBy("bucket").parquet(f"{self.root}/digests/batch=-1")

    def add(self, df: DataFrame, batch: int) -> None:
        """Notes the keys of rows that went into the table."""
        keys = self._digested(df).distinct().hint("rebalance", "bucket")
        keys.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/digests/batch={batch}")

    def duplicates(self, increment: DataFrame) -> DataFrame:
        """Each key of the increment that is not new or not single: its columns, ``in_increment`` (its rows there) and
        ``in_table``.  Rows of one key meet as one per task, however many there are."""
        keys = list(self.columns)
        counted = self._digested(increment, *keys).groupBy("_h1", "_h2", "bucket").agg(
            F.first(F.struct(*map(named, keys))).alias("_key"), F.count(F.lit(1)).alias("in_increment")
        )
        touched = [r.bucket for r in self._digested(increment).select("bucket").distinct().collect()]  # at most ``buckets``
        old = self._stored().filter(F.col("bucket").isin(touched)).select("_h1", "_h2").distinct()
        known = old.withColumn("_known", F.lit(True))
        joined = counted.join(known, ["_h1", "_h2"], "left").withColumn("in_table", F.coalesce("_known", F.lit(False)))
        return joined.filter("in_table OR in_increment > 1").select("_key.*", "in_increment", "in_table")

    def validate(self, increment: DataFrame) -> ValidationResult:
        """For a flow's audit: invalid if any key is repeated."""
        found = self.duplicates(increment).agg(
            F.coalesce(F.sum("in_increment"), F.lit(0)).alias("rows"),
            F.count_if("in_table").alias("in_table"),
            F.count_if(F.col("in_increment") > 1).alias("repeated"),
        )
        row = found.head()
        metrics: dict[str, Any] = row.asDict()
        errors = [f"{', '.join(self.columns)}: {row.in_table} keys are in the table already, {row.repeated} are repeated"]
        return ValidationResult(not row.rows, len(errors) if row.rows else 0, errors if row.rows else [], [], {"unique_index": metrics})
