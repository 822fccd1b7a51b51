"""Packing by multiway differencing (Karmarkar and Karp).

Documents are cut at fixed places into pieces of at most ``piece`` tokens.  Pieces go to groups of about
``windows_per_group`` windows; in a group, differencing starts with one partial partition per piece and repeatedly
merges the two with the largest spread, the heaviest windows of one with the lightest of the other, until one
partition into near-equal windows is left.  If a window exceeds the capacity the group is packed again with one
window more.  Full pieces of a whole window take a window of their own.

Only lengths and checksums are shuffled: one row per piece, never a token.  A group is bounded by its token count,
whatever the documents; a long document's pieces spread over groups.  An empty or NULL text is the end token alone.
Repeated rows are packed separately.  Equal lengths are ordered by content of the row, so reruns agree.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipekit.llm.common import stage_table, text_or_empty
from pipekit.llm.token_cache import load_tokenizer

WINDOW_TOKENS = 4096
PIECE_TOKENS = 1024
WINDOWS_PER_GROUP = 128
END_ID = 2
#: Words kept between tasks of a Python worker; bounds its memory, never the result.
MEMO_WORDS = 400_000

_LATIN = "".join(map(chr, range(0x250)))
_PLAIN = re.compile("[\t-\r -ɏ]*")


def _class(kinds: str) -> str:
    return "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] in kinds)


#: The .json form's own splitting rule, spelled out for the characters that ``_PLAIN`` admits.
_SPLIT = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[{l}]+|[{n}]|[^{l}{n}{s}]+".format(l=_class("L"), n=_class("N"), s="\t-\r \x85\xa0")
)


class WordEncoder:
    """Ids of whole texts, with the ids of known words kept.  Texts outside the Latin blocks, or with a special
    string, are given to the library whole."""

    def __init__(self, path: str) -> None:
        self.tokenizer = load_tokenizer(path)
        self.memo: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, words: set[str]) -> None:
        """Encodes new words in one text; each word ends at a token that carries the word-end mark."""
        ordered = sorted(words)
        for at in range(0, len(ordered), 2000):
            some = ordered[at : at + 2000]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                data, start = ids.tobytes(), 0
                for word, end in zip(some, (ends * 4).tolist(), strict=True):
                    self.memo[word] = data[start:end]
                    start = end
            else:
                for word in some:
                    self.memo[word] = self.whole(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        found: list[bytes | None] = []
        split: list[tuple[int, list[str]]] = []
        for place, text in enumerate(texts):
            plain = unicodedata.normalize("NFC", text)
            lower = plain.lower()  # some capitals lower to letters beyond the plain characters
            if _PLAIN.fullmatch(plain) and _PLAIN.fullmatch(lower) and not any(s in text for s in self.special):
                split.append((place, _SPLIT.findall(lower)))
                found.append(None)
            else:
                found.append(self.whole(text))
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = set(chain.from_iterable(words for _, words in split)).difference(self.memo)
        self.learn(new)
        memo = self.memo
        for place, words in split:
            found[place] = b"".join([memo[w] for w in words])
        return found


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cut(n: int, piece: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole windows first, then pieces of at most ``piece``."""
    out = [(s, window) for s in range(0, n - window + 1, window)]
    at = len(out) * window
    return out + [(s, min(piece, n - s)) for s in range(at, n, piece)]


def _pieces(path: str, piece: int, window: int, end_id: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            rows = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                for doc_id, data in zip(ids[at : at + 500], encoder.encode(texts[at : at + 500]), strict=True):
                    data += end
                    n = len(data) // 4
                    for start, length in cut(n, piece, window):
                        rows["doc_id"].append(doc_id)
                        rows["start"].append(start)
                        rows["length"].append(length)
                        rows["ids_crc32"].append(zlib.crc32(data[4 * start : 4 * (start + length)]))
                        rows["doc_tokens"].append(n)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in rows.items()})

    return run


def difference(lengths: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: k lists of indices with near-equal sums."""
    ticket = count()
    heap = []
    for i, n in enumerate(lengths):
        sums = np.zeros(k, dtype=np.int64)
        sums[-1] = n
        heap.append((-n, next(ticket), sums, [(i, k - 1)]))
    heapq.heapify(heap)
    # Partial partitions keep only sums and, per merge, where each of the two parts' windows went.
    parts: dict[int, tuple] = {}
    while len(heap) > 1:
        _, a, sums_a, _ = heapq.heappop(heap)
        _, b, sums_b, _ = heapq.heappop(heap)
        merged = sums_a + sums_b[::-1]
        order = np.argsort(merged, kind="stable")
        me = next(ticket)
        parts[me] = (a, b, order)
        sums = merged[order]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), me, sums, None))
    out: list[list[int]] = [[] for _ in range(k)]
    if not heap:
        return out
    # From the last merge down: for each part, the final window of each of its slots.
    todo = [(heap[0][1], np.arange(k))]
    while todo:
        node, where = todo.pop()
        if node in parts:
            a, b, order = parts[node]
            place = np.empty(k, dtype=np.int64)
            place[order] = where
            todo.append((a, place))
            todo.append((b, place[::-1]))
        else:
            out[int(where[-1])].append(node)
    return out


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of indices, none above the capacity; one window more for as long as one is exceeded."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        windows = difference(lengths, k)
        if all(sum(lengths[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += 1


_OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _pack_group(capacity: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = pdf["length"].tolist()
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        for number, window in enumerate(pack_lengths(lengths, capacity)):
            at = 0
            for i in sorted(window):
                sequence[i], offset[i] = number, at
                at += lengths[i]
        pdf["sequence_id"] = (int(key[0]) << 20) + sequence
        pdf["offset"] = offset
        return pdf[_NAMES]

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW_TOKENS,
    piece: int = PIECE_TOKENS,
    windows_per_group: int = WINDOWS_PER_GROUP,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its window (``sequence_id``, ``offset``)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = stage_table(rows.mapInArrow(_pieces(tokenizer, piece, window, end_id), schema), "pieces")
    whole = F.col("length") == window
    total = pieces.filter(~whole).agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (window * windows_per_group)))
    dealt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens", "copy"), F.lit(groups))
    loose = pieces.filter(~whole).withColumn("copy", F.monotonically_increasing_id()).withColumn("grp", dealt).drop("copy")
    packed = loose.groupBy("grp").applyInPandas(_pack_group(window), _OUT)
    full = pieces.filter(whole).select(
        "*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return packed.unionByName(full)
