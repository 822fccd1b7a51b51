"""Repeated strings by a depth-limited radix sort of suffixes.

A byte is removed if a string of ``threshold`` bytes that covers it starts anywhere else, in any document.  Suffixes are
ordered only as far as that: by most-significant-digit passes that put equal digits into one group, drop groups of one
suffix and send the rest to a longer digit, until groups that are equal over the whole threshold are left.

Digits are taken so that few suffixes enter.  Every window of ``threshold`` bytes has an anchor, the smallest hashed
16-gram of its first ``SPREAD`` ones; equal windows have equal anchors at equal distances, and neighbouring windows share
one.  The passes are

1. runs of windows with one anchor, by the bytes that all of them hold to the right of the anchor;
2. for runs in groups that hold different runs, blocks of ``BLOCK`` windows, by the bytes common to the block;
3. for blocks in groups that hold different blocks, the single windows.

A group of several equal runs (or blocks) needs no further pass: each of its windows is repeated.  The result is exact
but for equality being that of two 64-bit hashes.

Plan: passes ship hashes only, with per-task combine (the count and the smallest and largest content hash of a group);
text meets the marks of its document once, and the few documents with mixed groups again.  Groups are never
gathered, so a passage in a third of all documents is one counted row.  Long documents are read in steps.

Matches never cross documents.  NULL counts as empty.  Texts under the threshold keep everything.  Repeated rows
are documents of their own: their texts repeat each other.  Columns named in ``carry`` stay; others are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipekit.llm.common import content_key, mix64, stage_table, text_or_empty

THRESHOLD = 200
GRAM = 16
SPREAD = 136
BLOCK = 8
STEP = 1 << 20

_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _anchors(data: bytes, first: int, last: int) -> np.ndarray:
    """The anchor of each window start in [first, last)."""
    size = last - first + SPREAD - 1  # 16-grams that are looked at
    raw = np.frombuffer(data, dtype=np.uint8, count=size + GRAM - 1, offset=first)
    low = np.ndarray(size, dtype="<u8", buffer=raw, strides=(1,))
    high = np.ndarray(size, dtype="<u8", buffer=raw, offset=8, strides=(1,))
    with np.errstate(over="ignore"):
        h = mix64(low * np.uint64(0x9E3779B97F4A7C15) + mix64(high.copy()))
    best = (h & _HIGH) | np.arange(size, dtype=np.uint64)
    width = 1
    while 2 * width <= SPREAD:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    rest = SPREAD - width
    if rest:
        best = np.minimum(best[:-rest], best[rest:])
    return (best & _LOW).astype(np.int64) + first


def runs(data: bytes, threshold: int) -> list[tuple[int, int, int]]:
    """(anchor, first window, last window) of each run of windows with one anchor."""
    windows = len(data) - threshold + 1
    out: list[tuple[int, int, int]] = []
    for first in range(0, max(windows, 0), STEP):
        last = min(first + STEP, windows)
        anchor = _anchors(data, first, last)
        starts = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
        ends = np.append(starts[1:], len(anchor)) - 1
        out += zip(anchor[starts].tolist(), (starts + first).tolist(), (ends + first).tolist(), strict=True)
    return out


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def run_digits(data: bytes, threshold: int) -> tuple[list[int], list[int]]:
    """Of each run: the hash of what all its windows share, and of all it covers."""
    shared = threshold - SPREAD + 1
    h = xxhash.xxh3_64_intdigest
    cores, covers = [], []
    for a, p, q in runs(data, threshold):
        cores.append(h(data[a : a + shared]))
        covers.append(h(data[p : q + threshold], a - p))
    return cores, covers


def block_digits(data: bytes, threshold: int, chosen: list[tuple[int, int, int]]):
    """(first window, last window, shared hash, cover hash) of the blocks of runs."""
    h = xxhash.xxh3_64_intdigest
    for a, p, q in chosen:
        for j in range((a - q) // BLOCK, (a - p) // BLOCK + 1):
            at = a - BLOCK * j
            first, last = max(p, at - BLOCK + 1), min(q, at)
            core = h(data[at : at - BLOCK + 1 + threshold])
            yield first, last, core, h(data[first : last + threshold], at - first)


def merged(lows: list[int], highs: list[int], threshold: int) -> list[tuple[int, int]]:
    """Maximal covered byte ranges of windows low .. high."""
    out: list[list[int]] = []
    for low, high in sorted(zip(lows, highs, strict=True)):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + threshold)
        else:
            out.append([low, high + threshold])
    return [(a, b) for a, b in out]


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept)


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_RESULT = (
    ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()),
)
_OPEN = (
    ("_data", pa.binary()), ("_low", _INTS), ("_high", _INTS), ("_first", _INTS), ("_last", _INTS), ("_core", _LONGS), ("_cover", _LONGS),
)
_SPARK = {
    pa.int64(): T.LongType(),
    pa.string(): T.StringType(),
    pa.binary(): T.BinaryType(),
    _INTS: T.ArrayType(T.IntegerType()),
    _LONGS: T.ArrayType(T.LongType()),
}


def _spark_fields(fields: tuple) -> list[T.StructField]:
    return [T.StructField(name, _SPARK[kind]) for name, kind in fields]


def _done(data: bytes, low: list[int], high: list[int], threshold: int, with_text: bool) -> tuple:
    spans = merged(low, high, threshold)
    kept = without(data, spans) if spans else data
    text = kept.decode(errors="ignore") if with_text else None
    return len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), text


def _digest_runs(threshold: int):
    def run(batches):
        for batch in batches:
            cores, covers = [], []
            for text in batch.column(2).to_pylist():
                core, cover = run_digits(text.encode(), threshold)
                cores.append(_signed(core))
                covers.append(_signed(cover))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cores, _LONGS), pa.array(covers, _LONGS)],
                names=["k1", "k2", "core", "cover"],
            )

    return run


def _emit(batch: pa.RecordBatch, carried: int, rows: list[tuple], extra: tuple) -> pa.RecordBatch:
    fields = _RESULT + extra
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    arrays = [pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)]
    names = [batch.schema.names[i] for i in range(carried)] + [n for n, _ in fields]
    return pa.RecordBatch.from_arrays([*batch.columns[:carried], *arrays], names=names)


def _mark_runs(threshold: int, carried: int, with_text: bool):
    """Columns: carried, text, equal runs, mixed runs."""

    def run(batches):
        for batch in batches:
            rows = []
            columns = [batch.column(i).to_pylist() for i in range(carried, carried + 3)]
            for text, equal, mixed in zip(*columns, strict=True):
                data = text.encode()
                found = runs(data, threshold) if equal or mixed else []
                low, high = [found[i][1] for i in equal or ()], [found[i][2] for i in equal or ()]
                if mixed:
                    blocks = list(block_digits(data, threshold, [found[i] for i in sorted(mixed)]))
                    first, last, core, cover = zip(*blocks, strict=True)
                    rows.append((len(data), None, None, None, None, data, low, high, first, last, _signed(core), _signed(cover)))
                else:
                    rows.append((*_done(data, low, high, threshold, with_text), *[None] * len(_OPEN)))
            yield _emit(batch, carried, rows, _OPEN)

    return run


def _mark_blocks(threshold: int):
    """Columns: row, data, low, high, first, last, equal blocks, mixed blocks."""

    def run(batches):
        for batch in batches:
            lows, highs, starts, cores = [], [], [], []
            columns = [batch.column(i).to_pylist() for i in range(1, 8)]
            for data, low, high, first, last, equal, mixed in zip(*columns, strict=True):
                lows.append(low + [first[i] for i in equal or ()])
                highs.append(high + [last[i] for i in equal or ()])
                windows = [p for i in sorted(mixed or ()) for p in range(first[i], last[i] + 1)]
                starts.append(windows)
                cores.append(_signed([xxhash.xxh3_64_intdigest(data[p : p + threshold]) for p in windows]))
            arrays = [pa.array(lows, _INTS), pa.array(highs, _INTS), pa.array(starts, _INTS), pa.array(cores, _LONGS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["_row", "_low", "_high", "_first", "core"])

    return run


def _mark_windows(threshold: int, carried: int, with_text: bool):
    """Columns: carried, data, low, high, first, repeated windows."""

    def run(batches):
        for batch in batches:
            rows = []
            columns = [batch.column(i).to_pylist() for i in range(carried, carried + 5)]
            for data, low, high, first, equal in zip(*columns, strict=True):
                starts = [first[i] for i in equal or ()]
                rows.append(_done(data, low + starts, high + starts, threshold, with_text))
            yield _emit(batch, carried, rows, ())

    return run


def _groups(digits: DataFrame) -> DataFrame:
    """Groups of two or more equal digits; ``equal`` if what they cover is the same."""
    return (
        digits.select(F.explode(F.arrays_zip("core", "cover")).alias("d"))
        .select("d.core", "d.cover")
        .groupBy("core")
        .agg(F.count(F.lit(1)).alias("n"), F.min("cover").alias("least"), F.max("cover").alias("most"))
        .filter("n > 1")
        .select("core", (F.col("least") == F.col("most")).alias("equal"))
    )


def _marks(digits: DataFrame, keys: list[str]) -> DataFrame:
    """Per document, the places of its digits in groups of equal and of mixed contents."""
    places = digits.select(*keys, F.posexplode("core").alias("place", "core"))
    return (
        places.join(_groups(digits), "core")
        .groupBy(*keys)
        .agg(
            F.collect_set(F.when(F.col("equal"), F.col("place"))).alias("_equal"),
            F.collect_set(F.when(~F.col("equal"), F.col("place"))).alias("_mixed"),
        )
    )


def remove_repeats(
    docs: DataFrame, *, text: str = "text", carry: list[str] | None = None, threshold: int = THRESHOLD, with_text: bool = False
) -> DataFrame:
    """One row per document: the carried columns, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and, on request,
    ``kept_text`` (a character that lost a byte goes with it)."""
    if threshold < SPREAD + GRAM:
        raise ValueError(f"the threshold must be at least {SPREAD + GRAM} bytes")
    carry = ["doc_id"] if carry is None else carry
    result = T.StructType([docs.schema[c] for c in carry] + _spark_fields(_RESULT))
    opened = T.StructType(result.fields + _spark_fields(_OPEN))
    keyed = docs.select(*carry, text_or_empty(text).alias("_text"), *content_key(text))
    digits = stage_table(
        keyed.select("k1", "k2", F.col("_text"))
        .mapInArrow(_digest_runs(threshold), "k1 long, k2 long, core array<long>, cover array<long>")
        .withColumn("_row", F.monotonically_increasing_id()),
        "runs",
    )
    # Equal texts have equal marks; the content key brings them back to their texts.
    of_rows = digits.select("_row", "k1", "k2").join(_marks(digits, ["_row"]), "_row")
    marks = stage_table(
        of_rows.groupBy("k1", "k2").agg(F.first("_equal").alias("_equal"), F.first("_mixed").alias("_mixed")), "run-marks"
    )
    marked = (
        keyed.join(marks, ["k1", "k2"], "left")
        .select(*carry, "_text", "_equal", "_mixed")
        .mapInArrow(_mark_runs(threshold, len(carry), with_text), opened)
    )
    first = stage_table(marked.withColumn("_row", F.monotonically_increasing_id()), "blocks")
    finished = first.filter(F.col("kept_sha256").isNotNull()).select(*result.names)
    open_rows = first.filter(F.col("kept_sha256").isNull())
    blocks = open_rows.select("_row", F.col("_core").alias("core"), F.col("_cover").alias("cover"))
    second = stage_table(
        open_rows.join(_marks(blocks, ["_row"]), "_row", "left")
        .select("_row", "_data", "_low", "_high", "_first", "_last", "_equal", "_mixed")
        .mapInArrow(_mark_blocks(threshold), "_row long, _low array<int>, _high array<int>, _first array<int>, core array<long>"),
        "windows",
    )
    windows = second.select("_row", F.posexplode("core").alias("place", "core"))
    repeated = windows.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core")
    again = windows.join(repeated, "core").groupBy("_row").agg(F.collect_list("place").alias("_equal"))
    last = (
        open_rows.select("_row", *carry, "_data")
        .join(second.select("_row", "_low", "_high", "_first"), "_row")
        .join(again, "_row", "left")
        .select(*carry, "_data", "_low", "_high", "_first", "_equal")
        .mapInArrow(_mark_windows(threshold, len(carry), with_text), result)
    )
    return finished.unionByName(last)
