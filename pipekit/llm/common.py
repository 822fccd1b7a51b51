"""What the operators share: words, hashes, Arrow mapping and tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipekit.session import scratch_path

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

SHINGLE_WORDS = 5
SIMILARITY = 0.8

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 (bytes split at exactly the six characters above)."""
    return text.encode().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _S33)) * _M1
        x = (x ^ (x >> _S33)) * _M2
        return x ^ (x >> _S33)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def bound_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches of at most ``BATCH_BYTES``, unless the session has a size of its own: Spark and
    Python hold a batch several times, outside the heap, and a plan may run long after the operator has returned it."""
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, BATCH_BYTES)


def stage_table(df: DataFrame, tag: str) -> DataFrame:
    """Writes a frame to the shared folder and reads it back: later plans start from its files.  Texts stay there until the job
    ends, so they are stored by the codec that takes the least room."""
    bound_batches(df.sparkSession)
    path = scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_rows(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    return df.mapInArrow(function, schema)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc32_remainder(column: str, modulus: int) -> Column:
    """crc32 of a value as text, modulo; NULL ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def content_key(column: str) -> list[Column]:
    """A 128-bit content key as two longs."""
    text = text_or_empty(column)
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(0x5EED), text).alias("k2")]
