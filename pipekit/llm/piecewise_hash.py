"""Context-triggered piecewise hashing.

A rolling hash over the last seven bytes sets chunk boundaries wherever it hits a value modulo the block size, so
an edit moves only the boundaries next to it.  Each chunk gives one character of the signature; a fingerprint holds
the signatures at a block size and at twice that size.  Two fingerprints are compared where their block sizes meet:
likeness is ``1 - distance / (length + length)`` with insertions and deletions as edits, and 0 unless they share a
run of seven characters (or are equal).

Whole texts are hashed as UTF-8; NULL counts as empty.  The empty text has the fingerprint ``3::`` and likeness 1
only to itself.  Texts shorter than the window form one chunk.  Ties and repeated rows are ordered by content;
a NULL doc_id is the smallest.  Extra columns are ignored.

Each document also needs the next one by descending id.  Rows are range-partitioned and sorted by id, each task pairs
its rows, and only the first and last row of each partition meet in a second, small join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pipekit.llm.common import stage_table, text_or_empty

WINDOW = 7
SIGNATURE = 64
MIN_BLOCK = 3
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def rolling(data: bytes) -> np.ndarray:
    """Hash of the seven bytes that end at each position (fewer at the start)."""
    x = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    h = x.copy()
    power = 1
    with np.errstate(over="ignore"):
        for back in range(1, WINDOW):
            power = power * 2654435761 % 2**32
            h[back:] += x[:-back] * np.uint32(power)
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        h ^= h >> np.uint32(13)
    return h


def _signature(data: bytes, h: np.ndarray, block: int) -> str:
    ends = (np.flatnonzero(h % np.uint32(block) == block - 1) + 1).tolist()[: SIGNATURE - 1]
    out, start = [], 0
    for end in ends:
        out.append(_ALPHABET[xxhash.xxh3_64_intdigest(data[start:end]) & 63])
        start = end
    if start < len(data):
        out.append(_ALPHABET[xxhash.xxh3_64_intdigest(data[start:]) & 63])
    return "".join(out)


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at twice the block``."""
    block = MIN_BLOCK
    while block * SIGNATURE < len(data):
        block *= 2
    if not data:
        return f"{block}::"
    h = rolling(data)
    first = _signature(data, h, block)
    while block > MIN_BLOCK and len(first) < SIGNATURE // 2:
        block //= 2
        first = _signature(data, h, block)
    return f"{block}:{first}:{_signature(data, h, 2 * block)}"


def signature_likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    runs = {a[i : i + WINDOW] for i in range(len(a) - WINDOW + 1)}
    if not any(b[i : i + WINDOW] in runs for i in range(len(b) - WINDOW + 1)):
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    v = every  # bit-parallel longest common subsequence: cleared bits are matched characters
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & every
    common = len(a) - v.bit_count()
    return 2.0 * common / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1; 0 where their block sizes do not meet."""
    if a == b:
        return 1.0
    size_a, a1, a2 = a.split(":")
    size_b, b1, b2 = b.split(":")
    block_a, block_b = int(size_a), int(size_b)
    if block_a == block_b:
        return max(signature_likeness(a1, b1), signature_likeness(a2, b2) if a2 and b2 else 0.0)
    if block_a == 2 * block_b:
        return signature_likeness(a1, b2)
    if block_b == 2 * block_a:
        return signature_likeness(a2, b1)
    return 0.0


def edited(text: str, following: str) -> str:
    """The last half of the text replaced by the first as many characters of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_OPEN = f"{_ROW}, part int, place string, text string"


class _Out:
    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def paired(self, one, following_text: str, following_print: str) -> tuple:
        doc_id, text, own = one
        changed = edited(text, following_text).encode()
        print_changed = fingerprint(changed)
        return (
            doc_id,
            len(text),
            hashlib.sha256(changed).hexdigest(),
            own,
            print_changed,
            likeness(own, print_changed),
            likeness(own, following_print),
        )


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "int": pa.int32()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in text.split(", "))])


def _pair_partition(batches):
    from pyspark import TaskContext

    part, out, schema = TaskContext.get().partitionId(), _Out(), _schema(_OPEN)
    held = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            here = (doc_id, text, fingerprint(text.encode()))
            if held is None:
                rows.append((doc_id, None, None, here[2], None, None, None, part, "first", text))
            else:
                rows.append((*out.paired(held, text, here[2]), part, "done", None))
            held = here
        yield _batch(rows, schema)
    if held is not None:
        yield _batch([(held[0], None, None, held[2], None, None, None, part, "last", held[1])], schema)


def _pair_ends(batches):
    out, schema = _Out(), _schema(_ROW)
    for batch in batches:
        rows = [out.paired((i, t, p), nt, np_) for i, t, p, nt, np_ in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield _batch(rows, schema)


def fingerprint_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its fingerprint, that of its edited text, and both likenesses."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = rows.repartitionByRange(partitions, F.desc_nulls_last("doc_id")).sortWithinPartitions(
        F.desc_nulls_last("doc_id"), "text"
    )
    staged = stage_table(ordered.mapInArrow(_pair_partition, _OPEN), "piecewise")
    done = staged.filter(F.col("place") == "done").select(*_NAMES)
    # One row per partition, without texts: which partition holds rows after this one, around to the first.
    firsts = staged.filter(F.col("place") == "first")
    order = Window.orderBy("part")
    parts = firsts.select("part", F.lead("part").over(order).alias("after"), F.min("part").over(Window.partitionBy()).alias("start"))
    links = parts.select(F.col("part"), F.coalesce("after", "start").alias("next_part"))
    last = staged.filter(F.col("place") == "last").select("part", "doc_id", "text", "fingerprint")
    following = firsts.select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    ends = last.join(links, "part").join(following, "next_part")
    closed = ends.select("doc_id", "text", "fingerprint", "next_text", "next_print").mapInArrow(_pair_ends, _ROW)
    return done.unionByName(closed)
