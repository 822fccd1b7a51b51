"""Structured Streaming: file ingestion, expectations, change apply, late duplicates."""

from pipekit.streaming.changes import ChangeApplier
from pipekit.streaming.ingest import drop_late_duplicates, file_stream, run_available, write_stream
from pipekit.streaming.quality import METRICS_NAME, CountedBatches, expect_stream, stream_metrics

__all__ = [
    "METRICS_NAME",
    "ChangeApplier",
    "CountedBatches",
    "drop_late_duplicates",
    "expect_stream",
    "file_stream",
    "run_available",
    "stream_metrics",
    "write_stream",
]
