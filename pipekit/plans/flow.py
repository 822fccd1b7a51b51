"""Read, transform, stage, audit, publish."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipekit.operators.clean import Cleaner, DropNulls, StandardizeText
from pipekit.operators.enrich import Enricher, Lookup
from pipekit.operators.expectations import ExpectNonNull, ExpectUnique, ExpectationSuite, ValidationResult
from pipekit.operators.merge import MergeRule
from pipekit.protocols import Source, Step, Validator, Writer
from pipekit.sinks.store import MergeStats, TableStore


@dataclass(frozen=True)
class FlowResult:
    """``status`` is ``published``, ``rejected`` (the audit failed) or ``error``.  True when published."""

    status: str
    validation: Any = None
    error: str | None = None
    stats: MergeStats | None = None
    high_water_mark: Any = None

    def __bool__(self) -> bool:
        return self.status == "published"


@dataclass
class BatchFlow:
    """Source, steps, audit, table.

    The steps' result is written once, the audit reads those files, and only then does the table move to
    them; the source is never read a second time and what was audited is what is published.
    ``require_rows`` refuses an empty input to any step.  ``on_invalid``: ``return`` a rejected result or
    ``raise`` a ``ValueError``.
    """

    source: Source
    steps: Sequence[Step]
    validator: Validator
    store: TableStore
    partition_by: Sequence[str] = ()
    require_rows: bool = False
    on_invalid: str = "return"

    def transform(self, df: DataFrame) -> DataFrame:
        for i, step in enumerate(self.steps, start=1):
            if self.require_rows and df.isEmpty():
                raise ValueError(f"step {i} has no input rows")
            df = step(df)
        return df

    def execute(self, source_table: str, destination: str) -> FlowResult:
        try:
            result = self.transform(self.source.read_table(source_table))
            path = self.store.stage(result, destination, self.partition_by)
            validation = self.validator.validate(self.store.read_stage(path, result.schema))
            if validation:
                self.store.publish(destination, path, result.schema, self.partition_by)
                return FlowResult("published", validation)
        except Exception as error:  # noqa: BLE001 - a flow reports instead of raising, unless asked to
            if self.on_invalid == "raise":
                raise
            return FlowResult("error", error=f"{type(error).__name__}: {error}")
        if self.on_invalid == "raise":
            raise ValueError(f"validation failed: {validation}")
        return FlowResult("rejected", validation)


def run_simple(
    df: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    validator: Validator,
    writer: Writer,
    destination: str,
) -> None:
    """Process, validate, write; raises ``ValueError`` and writes nothing if invalid.  Validation and writing
    each evaluate the frame: use :class:`BatchFlow` where that is expensive."""
    processed = process(df)
    verdict = validator.validate(processed)
    if not verdict:
        raise ValueError(f"validation failed: {verdict}")
    writer.write(processed, destination)


# The default names below are those of the ready-made flow.
def standard_flow(
    source: Source,
    store: TableStore,
    lookup: DataFrame | str = "dim_customers",
    required: Sequence[str] = ("id", "created_date"),
    text: Sequence[str] = ("name", "description"),
    lookup_key: str = "customer_id",
    lookup_columns: Sequence[str] = ("customer_name", "region"),
    unique: Sequence[str] = ("id",),
    **settings: Any,
) -> BatchFlow:
    """The ready-made flow: drop rows without required values, trim text, add customer columns, and expect
    the required columns to be complete and the key to be unique."""
    cleaner = Cleaner([DropNulls(required), StandardizeText(text, "trim")])
    enricher = Enricher().add("customer_lookup", Lookup(lookup, lookup_key, lookup_columns))
    suite = ExpectationSuite([ExpectNonNull(required), ExpectUnique(unique)])
    return BatchFlow(source, [cleaner, enricher], suite, store, **settings)


@dataclass
class IncrementalFlow:
    """Rows past the mark, through the steps and the audit, merged into a table.

    The new mark is the largest value among the rows merged.  With ``inclusive`` reads, rows that share
    the old mark are merged again, which the key makes harmless, and none is missed.  With ``partition_by`` (columns
    of the key) only the partitions that the rows fall into are rewritten; columns that the table lacks are added
    if the rule evolves.
    """

    source: Source
    steps: Sequence[Step]
    validator: Validator
    store: TableStore
    rule: MergeRule
    watermark_column: str
    inclusive: bool = True
    partition_by: Sequence[str] = ()

    def execute(self, source_table: str, destination: str, last_value: Any) -> FlowResult:
        spark: SparkSession = self.store.spark
        try:
            df = self.source.read_incremental(source_table, self.watermark_column, last_value, self.inclusive)
            for step in self.steps:
                df = step(df)
            path = self.store.stage(df, f"{destination}_increment")
            staged = self.store.read_stage(path, df.schema)
            validation = self.validator.validate(staged)
            if not validation:
                return FlowResult("rejected", validation, high_water_mark=last_value)
            mark = staged.agg(F.max(self.watermark_column)).head()[0]
            mark = last_value if mark is None else mark
            if not spark.catalog.tableExists(destination):
                self.store.create_empty(destination, staged.schema, self.partition_by)
            if self.partition_by:
                stats = self.store.upsert_partitions(destination, staged, self.rule, self.partition_by)
            else:
                stats = self.store.upsert(destination, staged, self.rule)
            return FlowResult("published", validation, stats=stats, high_water_mark=mark)
        except Exception as error:  # noqa: BLE001 - a flow reports instead of raising
            return FlowResult("error", error=f"{type(error).__name__}: {error}", high_water_mark=last_value)


__all__ = ["BatchFlow", "FlowResult", "IncrementalFlow", "ValidationResult", "run_simple", "standard_flow"]
