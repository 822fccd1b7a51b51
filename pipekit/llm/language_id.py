"""Language identification by compression.

Each language has a raw-content zstandard dictionary, cut from a bounded sample of labelled texts.  A lower-cased
text is compressed in segments with every dictionary; the language with the fewest bytes wins.  Segments keep a long text
from becoming its own dictionary, so the whole text takes part with equal weight.

``fit`` takes at most ``texts_per_language`` different texts of a language, those with the smallest content hashes, and
``dictionary_bytes`` of them: these two parameters bound what reaches the driver.  Copies of a text count once.  Shares
are equal, but what a short text leaves of its share goes to longer ones, and a share is cut in pieces from all of its text.

A NULL text, or one without a letter, is ``und`` with score 0.  With no learned language every text is ``und``.
``rejected`` marks ``und`` and texts whose two smallest sizes differ by less than ``min_margin`` of the second.
Equal sizes go to the first language by name.  Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pipekit.llm.common import bound_batches

TEXTS_PER_LANGUAGE = 400
DICTIONARY_BYTES = 128 * 1024
#: Least length of the pieces that a text's share is cut in.
PIECE_BYTES = 100
SEGMENT_BYTES = 4096
MIN_MARGIN = 0.004
LEVEL = 5
UNKNOWN = "und"
#: Texts that leave a task together; bounds its memory, never the result.
TEXTS_AT_ONCE = 1000

_LETTER = re.compile(r"[^\W\d_]")
#: Bytes of a size difference that halve the score's odds.
_HALVING_BYTES = 2.0


def fit(
    labelled: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    texts_per_language: int = TEXTS_PER_LANGUAGE,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Dictionaries by language, from a bounded sample of the different texts that have a language."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.lower(text).alias("text")
    )
    bound_batches(labelled.sparkSession)
    # Narrow rows first: a text's copies share one hash and are one candidate.
    texts = rows.groupBy("lang", "h").agg(F.max(F.octet_length("text")).alias("size"))
    first = Window.partitionBy("lang").orderBy("h")
    ranked = texts.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= texts_per_language).collect()
    sizes: dict[str, dict[int, int]] = {}
    for row in sorted(ranked, key=lambda r: (r.lang, r.n)):
        sizes.setdefault(row.lang, {})[row.h] = row.size
    shares = [(language, h, n) for language, own in sizes.items() for h, n in _shares(own, dictionary_bytes).items()]
    if not shares:
        return {}
    wanted = labelled.sparkSession.createDataFrame(shares, "lang string, h long, share long")
    pieces = rows.join(F.broadcast(wanted), ["lang", "h"]).select("lang", "h", "share", "text")
    # A task sends a text's pieces once, and the tasks' copies meet as small rows.
    cut = pieces.mapInArrow(_cut, "lang string, h long, data binary").dropDuplicates(["lang", "h"])
    found = {(row.lang, row.h): bytes(row.data) for row in cut.collect()}
    return {language: b"\n".join(found[language, h] for h in own)[:dictionary_bytes] for language, own in sorted(sizes.items())}


def _shares(sizes: dict[int, int], total: int) -> dict[int, int]:
    """Bytes of each text, with a line break after it: equal shares of ``total``, what short texts leave dealt to the others."""
    out, left = {}, total
    for i, h in enumerate(sorted(sizes, key=lambda h: (sizes[h], h))):
        out[h] = min(sizes[h], max(1, left // (len(sizes) - i) - 1))
        left -= out[h] + 1
    return out


def spread(data: bytes, share: int) -> bytes:
    """``share`` bytes of a text, cut in pieces at equal distances from its start to its end."""
    if len(data) <= share:
        return data
    n = max(1, (share + 1) // (PIECE_BYTES + 1))
    ends = [(share - n + 1) * (i + 1) // n for i in range(n)]
    lengths = [end - start for start, end in zip([0, *ends], ends)]
    free = len(data) - sum(lengths)
    starts = [end - length + free * i // max(n - 1, 1) for i, (end, length) in enumerate(zip(ends, lengths))]
    return b"\n".join(data[start : start + length] for start, length in zip(starts, lengths))


def _cut(batches):
    seen: set[tuple[str, int]] = set()  # at most the sample's texts
    for batch in batches:
        languages, hashes, shares = (batch.column(k).to_pylist() for k in range(3))
        found = []
        for i, key in enumerate(zip(languages, hashes)):
            if key not in seen:
                seen.add(key)
                found.append((*key, spread(batch.column(3)[i].as_py().encode(), shares[i])))
        kinds = (pa.string(), pa.int64(), pa.binary())
        columns = zip(*found) if found else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), kind) for c, kind in zip(columns, kinds)], names=["lang", "h", "data"]
        )


@lru_cache(maxsize=2)
def _compressors(model: tuple[tuple[str, bytes], ...]):
    import zstandard

    found = []
    for language, content in model:
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        raw.precompute_compress(level=LEVEL)
        found.append(
            (
                language,
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False
                ).compress,
            )
        )
    return found


def sizes_of(text: str, model: tuple[tuple[str, bytes], ...]) -> dict[str, int]:
    data = text.lower().encode()
    n = max(1, -(-len(data) // SEGMENT_BYTES))
    each = -(-len(data) // n)
    parts = [data[i * each : (i + 1) * each] for i in range(n)]
    return {language: sum(len(compress(p)) for p in parts) for language, compress in _compressors(model)}


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float, float]:
    """Language, score and margin of one text."""
    if not model or not text or not _LETTER.search(text):
        return UNKNOWN, 0.0, 0.0
    ranked = sorted((size, language) for language, size in sizes_of(text, model).items())
    best, language = ranked[0]
    odds = sum(2.0 ** (-min(size - best, 2000) / _HALVING_BYTES) for size, _ in ranked)
    margin = (ranked[1][0] - best) / ranked[1][0] if len(ranked) > 1 else 1.0
    return language, 1.0 / odds, margin


def identify(
    docs: DataFrame,
    model: dict[str, bytes],
    *,
    text: str = "text",
    min_margin: float = MIN_MARGIN,
    prefix: str = "",
) -> DataFrame:
    """The rows with ``lang_pred``, ``score``, ``margin`` and ``rejected`` (each with the prefix) appended."""
    frozen = tuple(model.items())
    added = [prefix + name for name in ("lang_pred", "score", "margin", "rejected")]
    if clash := {c.lower() for c in docs.columns} & {a.lower() for a in added}:
        raise ValueError(f"columns {sorted(clash)} exist already; choose a prefix")
    position, names = docs.columns.index(text), [*docs.columns, *added]

    def run(batches):
        for batch in (large.slice(at, TEXTS_AT_ONCE) for large in batches for at in range(0, large.num_rows, TEXTS_AT_ONCE)):
            found = [classify(t.as_py(), frozen) for t in batch.column(position)]
            rejected = [language == UNKNOWN or margin < min_margin for language, _, margin in found]
            arrays = [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.float64()),
                pa.array(rejected, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    bound_batches(docs.sparkSession)
    schema = docs.schema
    for name, kind in zip(added, ("string", "double", "double", "boolean"), strict=True):
        schema = schema.__class__(schema.fields.copy()).add(name, kind)
    return docs.mapInArrow(run, schema)
