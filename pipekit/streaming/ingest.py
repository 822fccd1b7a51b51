"""File streams with exactly-once progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_format: str = "parquet",
    max_files: int | None = None,
    max_bytes: str | None = None,
) -> DataFrame:
    """New files under a directory or glob.  ``max_files`` or ``max_bytes`` (such as ``"500g"``) bounds a
    micro-batch, not the stream."""
    reader = spark.readStream.format(file_format).schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.load(path)


def write_stream(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> DataStreamWriter:
    """Parquet sink: the checkpoint and the sink's own log make a restart neither repeat nor lose files."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy(*partition_by) if partition_by else writer


def run_available(writer: DataStreamWriter) -> StreamingQuery:
    """Processes everything there is, in as many micro-batches as it takes, and stops."""
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drop_late_duplicates(
    stream: DataFrame, keys: Sequence[str], time_column: str, delay: str, salts: int = 1
) -> DataFrame:
    """First arrival per key; repeats that come at most ``delay`` later are dropped.  State is spread by
    key hash and forgotten once the watermark has passed, so it does not grow with the stream.

    A key with very many copies would still meet in one task.  With ``salts`` its copies are first thinned
    out in that many groups, by the input partition they came from, at the price of a second stateful
    step.
    """
    kind = stream.schema[time_column].dataType
    if not isinstance(kind, T.TimestampType):  # watermarks need a time with zone
        stream = stream.withColumn(time_column, stream[time_column].cast("timestamp"))
    timed = stream.withWatermark(time_column, delay)
    if salts > 1:
        salted = timed.withColumn("_salt", F.spark_partition_id() % salts)
        timed = salted.dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt")
    return timed.dropDuplicatesWithinWatermark(list(keys))
