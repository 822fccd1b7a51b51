"""Quality rule: lines that many documents of a host share are boilerplate.

Every line is normalised (ASCII digits to 0, lower case, white space squeezed) and hashed.  For each host the
distinct documents that hold a line are counted; a line held by more than ``max(min_documents, share * documents
of the host)`` of them is removed, and a document is rejected as depleted if less than ``min_left`` of its words
remain.

Plan: one Arrow pass hashes the lines of each document (written to the shared folder, arrays only), an aggregation
with per-task combine counts them, and the lines join the few frequent ones with the large side on the left, where
Spark may split a hot line.  No text is shuffled.

NULL and empty texts have no words and no lines; they fail the base rules.  Repeated rows are rows of one
document: they count once per line.  NULL hosts are one host.  Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipekit.llm.common import stage_table

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_DOCUMENTS = 10
HOST_SHARE = 0.01
MIN_LEFT = 0.5

_SYMBOLS = "#*$%&|<>"
_SPACE = re.compile(r"[ \t-\r]")
_DIGITS = bytes.maketrans(b"123456789", b"000000000")

_SCHEMA = (
    "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "lines array<long>, line_words array<int>"
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    if len(ids) == n:
        return 0
    pair = w[:-1] * len(ids) + w[1:]
    if len(ids) >= 2_000_000:  # three ids no longer fit 63 bits: renumber the pairs
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(ids) + w[2:]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] >= 2)
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[starts + shift] = True
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """Base measures and the hashed lines of one text."""
    text = text or ""
    words = text.encode().split()
    if not words:
        return 0, 0, 0, 0, 0, [], []
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in _SYMBOLS)
    seen: set[str] = set()
    duplicates = 0
    for line in text.split("\n"):
        if line in seen:
            duplicates += 1
        elif line.strip(" \t\x0b\x0c\r"):
            seen.add(line)
    hashes, sizes = [], []
    for line in text.lower().encode().translate(_DIGITS).split(b"\n"):
        parts = line.split()
        if parts:
            hashes.append(xxhash.xxh3_64_intdigest(b" ".join(parts)))
            sizes.append(len(parts))
    signed = np.array(hashes, dtype=np.uint64).view(np.int64).tolist()
    return len(words), chars, symbols, duplicates, repeated_words(words), signed, sizes


def _measure_batches(batches):
    for batch in batches:
        columns = list(zip(*map(measure, batch.column(2).to_pylist()), strict=True)) or [[]] * 7
        types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
        arrays = [batch.column(0), batch.column(1)] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _SCHEMA.split(", ")])


def line_frequency(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    host_share: float = HOST_SHARE,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """One row per document: base measures, ``n_removed_lines``, ``n_removed_words`` and the verdict ``kept``."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text))
    measured = stage_table(
        narrow.mapInArrow(_measure_batches, _SCHEMA).withColumn("row", F.monotonically_increasing_id()), "lines"
    )
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("host_documents"))
    frequent = (
        measured.select("host", "doc_id", F.explode(F.array_distinct("lines")).alias("line"))
        .groupBy("host", "line")
        .agg(F.countDistinct(F.coalesce("doc_id", F.lit(-1))).alias("documents"))
        .filter(F.col("documents") > min_documents)
    )
    same_host = F.col("f.host").eqNullSafe(F.col("h.host"))
    limit = F.greatest(F.lit(float(min_documents)), F.lit(host_share) * F.col("host_documents"))
    frequent = (
        frequent.alias("f").join(hosts.alias("h"), same_host).filter(F.col("documents") > limit).select("f.host", "line")
    )
    line = F.explode(F.arrays_zip("lines", "line_words")).alias("l")
    occurrences = measured.select("row", "host", line).select(
        "row", "host", F.col("l.lines").alias("line"), F.col("l.line_words").alias("words")
    )
    removed = (
        occurrences.alias("o")
        .join(frequent.alias("f"), (F.col("o.line") == F.col("f.line")) & F.col("o.host").eqNullSafe(F.col("f.host")))
        .groupBy("row")
        .agg(F.count(F.lit(1)).alias("n_removed_lines"), F.sum("words").alias("n_removed_words"))
    )
    out = measured.drop("lines", "line_words").join(removed, "row", "left").drop("row")
    out = out.fillna(0, ["n_removed_lines", "n_removed_words"])
    failed = base_failed()
    left = F.col("n_words") - F.col("n_removed_words")
    return out.withColumns({"base_failed": failed, "kept": ~failed & (left >= min_left * F.col("n_words"))})


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def without_frequent_lines(text: str | None, frequent: set[int]) -> str:
    """A text without the lines whose hashes are given."""
    kept = []
    for line in (text or "").split("\n"):
        parts = line.lower().encode().translate(_DIGITS).split()
        h = xxhash.xxh3_64_intdigest(b" ".join(parts)) if parts else None
        if h is None or np.uint64(h).astype(np.int64) not in frequent:
            kept.append(line)
    return "\n".join(kept)
