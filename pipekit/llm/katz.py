"""Language-model scores by a Katz backoff bigram model.

Tokens are the words of a text with A-Z lowered, then one end token.  Counts come from the training documents.  Pair
counts 1 to ``K`` are discounted by Good-Turing ratios, larger ones by the constant ``TAIL``, so every history keeps some
mass; the same holds for single words, whose left-over mass goes to unknown words as one type.  A token's probability
is looked up recursively::

    P(w | h) = d(c(h, w)) * c(h, w) / c(h)      if c(h, w) > 0
             = alpha(h) * P(w)                  if c(h) > 0
             = P(w)                             otherwise
    alpha(h) = (1 - sum of P(w | h) over the words seen after h) / (1 - sum of P(w) over the same words)

so that each history's probabilities add up to one exactly.

How it runs.  A log probability is a sum of terms that need a pair's count, a word's count, a history's weight and the
discounts.  Tasks turn each batch of documents into packed pairs, equal pairs counted once with the documents that hold
them, and deal them by word.  Where the pairs of a word meet, both counts are known; what still depends on the discounts
is kept as counts of counts, so one pass is enough.  It leaves partitioned tables: of histories (from which the backoff
weights follow), of documents' partial sums (packed, ``1 << GROUP_BITS`` documents a row), and of the unseen pairs of
held-out documents, which join their histories' weights.  Words that the same sample shows to be common travel as their place
in a list that every task has, all others as their hash.  Discounts come from a dozen totals.  With ``pairs=True`` the pair counts themselves are stored too.

The end token, and words that a sample shows to hold more than a task's mean share of the tokens, are not dealt by word, but by
pair; pairs that the sample shows to be hot go to any task.  Each task sends its own counts of these words and pairs to all
others, so that wherever their tokens meet, their counts are known.  The sample only decides which way a token takes:
counts are exact either way.

NULL texts are empty: the end token alone.  Repeated rows are documents of their own.  A NULL doc_id is hashed as the
empty text.  With no training documents nothing is known: N and V are 0 and every token has the unknown word's
probability 1, while the base score is then log10 of 1.  Words and pairs are told apart by 64-bit hashes.  Extra columns are
ignored.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipekit.llm.common import crc32_remainder, hash_words, mix64, stage_table, text_or_empty

K = 5
TAIL = 0.01
END, START = np.uint64(1), np.uint64(2)
#: Most tokens of a batch, unless it is one text: half as many as its bytes.
BATCH_TOKENS = 1_000_000
#: Unpacked bytes that a task works on at once.
SLICE_BYTES = 12 << 20

_CLASSES = [f"seen{r}" for r in range(1, K + 1)]
_UNSEEN = [f"word{r}" for r in range(1, K + 1)]
_INTS = ["n_tokens", "n_known", "n_unknown_unseen", "n_tail", *_CLASSES, *_UNSEEN]
_FLOATS = ["base_log", "score_log", "sum_word"]
#: Keys whose sums a task holds before it sends them on; Spark adds the parts of a key.
SUM_ROWS = 200_000
#: Words that packed rows name by their place in the list of common words.
COMMON_WORDS = 100_000
#: Documents whose sums and own columns travel together.
GROUP_BITS = 6
#: Share of the documents that are searched for heavy words.
SAMPLE = 1 / 16
#: What a packed row holds.
_PAIRS, _META, _HEAVY, _TOTALS = 0, 1, 2, 3
#: A pair is hot above this part of a task's mean share of the tokens.
HOT_PART = 4
#: kind: d documents' sums and m documents' own columns (key: group, data: packed), h history, u unseen pair, s totals, p pair,
#: e heavy word (n_known: word, n_tokens: times in training).
_SCHEMA = (
    "kind string, key long, other long, "
    + ", ".join(f"{c} long" for c in _INTS)
    + ", "
    + ", ".join(f"{c} double" for c in _FLOATS)
    + ", data binary"
)


def ascii_lower_words(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def _narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in as few bytes as hold them."""
    most = int(a.max()) if a.size else 0
    return a.astype(next(f"<u{size}" for size in (1, 2, 4, 8) if most < 1 << 8 * size))


@cache
def _compressor() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=1)


@cache
def _decompressor() -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor()


def _blob(*arrays: np.ndarray) -> bytes:
    """Compressed arrays; bytes of equal weight lie together."""
    head = struct.pack(f"<{len(arrays)}Q", *(len(a) << 4 | a.itemsize for a in arrays))
    planes = (np.ascontiguousarray(a).view("u1").reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    return head + _compressor().compress(b"".join(planes))


def _unblob(data: bytes | pa.Buffer, n: int, kinds: str | None = None) -> list[np.ndarray]:
    """The arrays of a blob, unsigned unless ``kinds`` has another letter for each."""
    heads = struct.unpack(f"<{n}Q", data[: 8 * n])
    raw, at, out = _decompressor().decompress(data[8 * n :]), 0, []
    for head, kind in zip(heads, kinds or "u" * n, strict=True):
        count, size = head >> 4, head & 15
        planes = np.frombuffer(raw, dtype="u1", count=count * size, offset=at).reshape(size, count)
        out.append(np.ascontiguousarray(planes.T).view(f"<{kind}{size}").reshape(-1))
        at += count * size
    return out


def _coded(words: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    """Ascending words: which of them are common, steps of their places, steps of the others."""
    at = np.searchsorted(common, words).clip(max=len(common) - 1)
    hit = common[at] == words
    steps = at[hit], words[~hit]
    for x in steps:
        x[1:] -= x[:-1].copy()
    return [np.packbits(hit), _narrow(steps[0]), steps[1]]


def _decoded(bits: np.ndarray, places: np.ndarray, others: np.ndarray, common: np.ndarray) -> np.ndarray:
    hit = np.unpackbits(bits, count=len(places) + len(others)).astype(bool)
    out = np.empty(len(hit), np.uint64)
    out[hit], out[~hit] = common[np.cumsum(places, dtype=np.int64)], np.cumsum(others, dtype=np.uint64)
    return out


#: words (coded), pairs per word, distinct histories (coded), history of each pair, training count and holders of each pair, the
#: holders' documents and their counts.  Heavy words and their histories change places.
_PACKED = 12


def _unpacked(data: bytes | pa.Buffer, common: np.ndarray) -> list[np.ndarray]:
    a = _unblob(data, _PACKED)
    return [_decoded(*a[:3], common), a[3], _decoded(*a[4:7], common), *a[7:]]


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new key begins."""
    n = len(sorted_keys[0])
    new = np.ones(n, dtype=bool)
    if n:
        new[1:] = False
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _lengths(starts: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(len(starts), np.int64)
    out[:-1], out[-1:] = starts[1:], n
    return out - starts


def _pair_keys(words: np.ndarray, histories: np.ndarray) -> np.ndarray:
    return mix64(mix64(words) + histories)


@dataclass(frozen=True)
class _Frequent:
    """What the sample shows.  Heavy words, common words and hot pairs' keys ascend; the words of hot pairs are heavy."""

    heavy: np.ndarray
    common: np.ndarray
    hot: np.ndarray
    hot_words: np.ndarray
    hot_histories: np.ndarray


def _places(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in a list, and where those are."""
    if not len(sorted_values):
        return np.zeros(len(values), bool), np.empty(0, np.int64)
    at = np.searchsorted(sorted_values, values).clip(max=len(sorted_values) - 1)
    hit = sorted_values[at] == values
    return hit, at[hit]


def _tokenized(texts: list[bytes | None]):
    """The hashes of the distinct words, the end and the start; each token's word and history among them, the tokens' documents."""
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    parts = []
    for text in texts:
        found = text.split()
        parts.append(np.fromiter(map(ids.__getitem__, found), dtype=np.int32, count=len(found)))
    names = np.append(hash_words(list(ids)) | np.uint64(4), [END, START])  # 0 to 3 are not words
    lengths = np.array([len(part) + 1 for part in parts])
    ends = np.cumsum(lengths) - 1
    words = np.empty(lengths.sum(), dtype=np.int32)
    is_end = np.zeros(len(words), dtype=bool)
    is_end[ends] = True
    words[is_end] = len(ids)
    words[~is_end] = np.concatenate(parts)
    histories = np.empty(len(words), dtype=np.int32)
    histories[1:] = words[:-1]
    histories[ends - lengths + 1] = len(ids) + 1
    return names, words, histories, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def _counted(first: np.ndarray, second: np.ndarray, docs: np.ndarray, train: np.ndarray):
    """Tokens in the order of (first, second, document): each pair's two places, training count and holders, then the
    holders' documents and counts."""
    bits = [int(x.max(initial=0)).bit_length() for x in (second, docs)]
    key = first.astype(np.uint64)
    for more, n in zip((second, docs), bits, strict=True):
        key <<= np.uint64(n)
        key |= more.astype(np.uint64)
    key.sort()
    entry = _starts(key)
    times = _lengths(entry, len(key))
    key = key[entry]
    docs = (key & np.uint64((1 << bits[1]) - 1)).astype(np.int64)
    key >>= np.uint64(bits[1])
    pair = _starts(key)
    key = key[pair]
    holders = _lengths(pair, len(docs))
    trained = np.add.reduceat(times * train[docs], pair) if len(pair) else np.empty(0, np.int64)
    return (key >> np.uint64(bits[0])).astype(np.int64), (key & np.uint64((1 << bits[0]) - 1)).astype(np.int64), trained, holders, docs, times


def _blobs(bucket, first, second, trained, holders, docs, times, buckets: int, common: np.ndarray):
    """(bucket, blob) of pairs in the order of (bucket, first)."""
    pair_edges = np.searchsorted(bucket, np.arange(buckets + 1))
    edges = np.append(0, np.cumsum(holders))[pair_edges]
    for b in np.flatnonzero(np.diff(pair_edges)).tolist():
        lo, hi, plo, phi = edges[b], edges[b + 1], pair_edges[b], pair_edges[b + 1]
        own = _starts(first[plo:phi])
        names, where = np.unique(second[plo:phi], return_inverse=True)
        yield b, _blob(
            *_coded(first[plo:phi][own], common),
            _narrow(_lengths(own, phi - plo)),
            *_coded(names, common),
            _narrow(where),
            _narrow(trained[plo:phi]),
            _narrow(holders[plo:phi]),
            _narrow(docs[lo:hi]),
            _narrow(times[lo:hi]),
        )


def _dealt(texts: list[bytes], train: np.ndarray, buckets: int, frequent: _Frequent, number: int):
    """The tokens of a batch of documents: (bucket, what it holds, blob), and the training counts of heavy words and hot pairs."""
    names, words, histories, docs = _tokenized(texts)
    order = np.argsort(names)
    place = np.empty(len(names), dtype=np.int32)
    place[order] = np.arange(len(names))
    names, words, histories = names[order], place[words], place[histories]
    heavy, at = _places(frequent.heavy, names)
    totals = np.zeros(len(frequent.heavy), np.int64), np.zeros(len(frequent.hot), np.int64)
    np.add.at(totals[0], at, np.bincount(words[train[docs] > 0], minlength=len(names))[heavy])
    is_heavy = heavy[words]
    cold = ~is_heavy

    # Words lie in the order of their buckets, then of their hashes.
    bucket = (mix64(names) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place[order] = np.arange(len(names))
    w, h, *rest = _counted(place[words[cold]], histories[cold], docs[cold], train)
    rows = [(b, _PAIRS, x) for b, x in _blobs(bucket[order][w], names[order][w], names[h], *rest, buckets, frequent.common)]

    h, w, trained, holders, docs, times = _counted(histories[is_heavy], words[is_heavy], docs[is_heavy], train)
    keys = _pair_keys(names[w], names[h])
    hot, at = _places(frequent.hot, keys)
    np.add.at(totals[1], at, trained[hot])
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    bucket[hot] = (bucket[hot] + number) % buckets
    order = np.argsort(bucket, kind="stable")
    of_entry = np.argsort(np.repeat(bucket, holders), kind="stable")
    pairs = [x[order] for x in (bucket, names[h], names[w], trained, holders)]
    rows += [(b, _HEAVY, x) for b, x in _blobs(*pairs, docs[of_entry], times[of_entry], buckets, frequent.common)]
    return rows, totals


def _runs(items: Iterable, size: Callable, most: int):
    """Consecutive items of at most ``most`` together, or one."""
    run, total = [], 0
    for item in items:
        if run and total + size(item) > most:
            yield run
            run, total = [], 0
        run.append(item)
        total += size(item)
    if run:
        yield run


def _sampled(rows: DataFrame, buckets: int) -> _Frequent:
    """Heavy words: the end token, words that seem to hold over 1 / ``buckets`` of the tokens, and words of hot pairs.  Hot pairs seem
    to hold over 1 / (``HOT_PART`` * ``buckets``) of them.  Common words: those found most often, at most ``COMMON_WORDS`` and
    the end and start."""

    def run(batches):
        texts = ((t or "").encode().lower() for batch in batches for t in batch.column(0).to_pylist())
        for part in _runs(texts, lambda text: len(text) // 2 + 2, BATCH_TOKENS):
            names, words, histories, _ = _tokenized(part)
            counts = np.bincount(words, minlength=len(names))
            often = counts * 2 * buckets > len(words)
            often |= counts >= max(2, np.sort(counts)[-COMMON_WORDS:].min(initial=2))
            pairs, times = np.unique(words.astype(np.int64) << 32 | histories, return_counts=True)
            hot = times * 2 * HOT_PART * buckets > len(words)
            pairs, times = pairs[hot], times[hot]
            found = np.concatenate((names[often], names[pairs >> 32])).view("i8")
            before = np.concatenate((np.zeros(often.sum(), np.uint64), names[pairs & 0xFFFFFFFF])).view("i8")
            columns = np.append(found, 0), np.append(before, 0), np.concatenate((counts[often], times, [len(words)]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "history", "n"])

    counts = rows.select("text").sample(SAMPLE, seed=1).mapInArrow(run, "word long, history long, n long")
    counts = stage_table(counts.groupBy("word", "history").agg(F.sum("n").alias("n")), "katz_sample")
    total = counts.filter("word = 0").agg(F.max("n")).first()[0] or 0
    words = counts.filter("word != 0 AND history = 0").orderBy(F.desc("n"), "word").limit(max(2 * buckets, COMMON_WORDS)).select("word", "n").collect()
    pairs = counts.filter(F.col("history") != 0).filter(F.col("n") * (HOT_PART * buckets) > total).select("word", "history").collect()

    def unsigned(values: list[int]) -> np.ndarray:
        return np.array(values, dtype=np.int64).view(np.uint64)

    hot_words, hot_histories = unsigned([r.word for r in pairs]), unsigned([r.history for r in pairs])
    hot = _pair_keys(hot_words, hot_histories)
    order = np.argsort(hot)
    heavy = unsigned([r.word for r in words[: 2 * buckets] if r.n * buckets > total])
    heavy = np.unique(np.concatenate(([END], heavy, hot_words)))
    common = np.unique(np.append(unsigned([r.word for r in words[:COMMON_WORDS]]), [END, START]))
    return _Frequent(heavy, common, hot[order], hot_words[order], hot_histories[order])


def _pack(buckets: int, frequent: _Frequent):
    def run(batches):
        from pyspark import TaskContext

        first = base = TaskContext.get().partitionId() << 33
        number = base >> 33
        sums = np.zeros(len(frequent.heavy), np.int64), np.zeros(len(frequent.hot), np.int64)

        def rows(found: list[tuple[int, int, bytes]], flags: bytes = b""):
            holds = [h for _, h, _ in found]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([b for b, _, _ in found], pa.int32()),
                    pa.array([buckets if h == _TOTALS else base for h in holds], pa.int64()),
                    pa.array(holds, pa.int32()),
                    pa.array([flags if h == _META else b"" for h in holds], pa.binary()),
                    pa.array([x for _, _, x in found], pa.binary()),
                ],
                names=["bucket", "base", "holds", "train", "data"],
            )

        for batch in batches:
            ids, train_flags = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=np.int64)
            texts, start, size = [], 0, 0
            for at in range(batch.num_rows + 1):
                text = (batch.column(2)[at].as_py() or "").encode().lower() if at < batch.num_rows else None
                if texts and (text is None or size + len(text) // 2 + 2 > BATCH_TOKENS):
                    train = train_flags[start:at]
                    found, totals = _dealt(texts, train, buckets, frequent, number)
                    for s, t in zip(sums, totals, strict=True):
                        s += t
                    own = np.array([-1 if i is None else i for i in ids[start:at]], dtype="<i8")
                    null = np.array([i is None for i in ids[start:at]], dtype="u1")
                    # The documents' own columns travel once, to any bucket.
                    found.append((number % buckets, _META, own.tobytes() + null.tobytes()))
                    yield rows(found, train.astype("u1").tobytes())
                    base, number, texts, start, size = base + len(texts), number + 1, [], at, 0
                if text is not None:
                    texts.append(text)
                    size += len(text) // 2 + 2
        if base > first:
            data = _blob(*(s.view(np.uint64) for s in sums))
            yield rows([(b, _TOTALS, data) for b in range(buckets)])

    return run


def _sum(groups: np.ndarray, n: int, values=None) -> np.ndarray:
    return np.bincount(groups, weights=values, minlength=n)


_TYPES = pa.schema(
    [("kind", pa.string()), ("key", pa.int64()), ("other", pa.int64())]
    + [(c, pa.int64()) for c in _INTS]
    + [(c, pa.float64()) for c in _FLOATS]
    + [("data", pa.binary())]
)
OUT_ROWS = 20_000


def _rows(kind: str, key: np.ndarray, **columns):
    """Record batches of one kind; columns that it does not use are NULL."""
    for at in range(0, len(key), OUT_ROWS):
        n = min(OUT_ROWS, len(key) - at)
        arrays = []
        for field in _TYPES:
            if field.name == "kind":
                arrays.append(pa.array([kind] * n, pa.string()))
            elif field.name == "key":
                arrays.append(pa.array(key[at : at + n].astype("i8")))
            elif field.name == "data" and "data" in columns:
                arrays.append(pa.array(columns["data"][at : at + n], pa.binary()))
            elif field.name in columns:
                dtype = "f8" if field.type == pa.float64() else "i8"
                arrays.append(pa.array(columns[field.name][at : at + n].astype(dtype)))
            else:
                arrays.append(pa.nulls(n, field.type))
        yield pa.RecordBatch.from_arrays(arrays, schema=_TYPES)


class _Sums:
    """Sums by key, added slice by slice until they are sent on."""

    whole, fractions, dtype = _INTS, _FLOATS, np.int64

    def __init__(self, most: int = SUM_ROWS) -> None:
        self.most = most
        self.keys = np.empty(0, np.int64)
        self.ints = np.empty((0, len(self.whole)), self.dtype)
        self.floats = np.empty((0, len(self.fractions)))

    def add(self, keys: np.ndarray, columns: dict[str, np.ndarray]) -> None:
        """``keys`` are unique."""
        old = len(self.keys)
        self.keys, where = np.unique(np.concatenate((self.keys, keys)), return_inverse=True)
        for names, name in ((self.whole, "ints"), (self.fractions, "floats")):
            before = getattr(self, name)
            after = np.zeros((len(self.keys), len(names)), before.dtype)
            after[where[:old]] = before
            more = np.zeros((len(keys), len(names)), before.dtype)
            for i, column in enumerate(names):
                if column in columns:
                    more[:, i] = columns[column]
            after[where[old:]] += more
            setattr(self, name, after)

    def room(self, kind: str, more: int):
        """Sends the sums on unless ``more`` keys fit beside them."""
        if len(self.keys) + more > self.most:
            yield from self.rows(kind)

    def rows(self, kind: str):
        columns = {c: self.ints[:, i] for i, c in enumerate(self.whole)} | {c: self.floats[:, i] for i, c in enumerate(self.fractions)}
        yield from _rows(kind, self.keys, **{c: v for c, v in columns.items() if v.any()})
        self.__init__(self.most)


class _DocumentSums(_Sums):
    """Sums by document, sent on packed.  A text has less than 2**31 tokens."""

    fractions, dtype = ["base_log", "score_log"], np.int32

    def rows(self, kind: str):
        yield from _group_rows(kind, self.keys, *_narrow(self.ints).T, *self.floats.T)
        self.__init__(self.most)


def _group_rows(kind: str, rows: np.ndarray, *columns: np.ndarray):
    """A row for each group of documents; ``rows`` ascend."""
    groups = rows >> GROUP_BITS
    starts = _starts(groups)
    edges = np.append(starts, len(rows))
    places = (rows & ((1 << GROUP_BITS) - 1)).astype("u1")
    # Columns of one type travel as one array.
    kinds = [np.stack([c for c in columns if c.dtype == k]) for k in dict.fromkeys(c.dtype for c in columns)]
    data = [_blob(places[a:b], *(k[:, a:b].reshape(-1) for k in kinds)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    yield from _rows(kind, groups[starts], data=data)


def _sum_groups(batches):
    """Documents' own columns and whole sums, group after group as the rows are sorted."""

    def whole(group: int, parts: list[tuple[str, pa.Buffer]]):
        n = 1 << GROUP_BITS
        ints, floats, present = np.zeros((len(_INTS), n), np.int64), np.zeros((2, n)), np.zeros(n, bool)
        ids, null, out_of_training = np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
        for kind, data in parts:
            if kind == "d":
                at, i, f = _unblob(data, 3, "uuf")
                ints[:, at] += i.reshape(len(_INTS), -1)
                floats[:, at] += f.reshape(2, -1)
            else:
                at, own, flags = _unblob(data, 3, "uiu")
                ids[at], (null[at], out_of_training[at]), present[at] = own, flags.reshape(2, -1).astype(bool), True
        there = np.flatnonzero(present)
        arrays = [pa.array((group << GROUP_BITS) + there), pa.array(ids[there], mask=null[there]), pa.array(out_of_training[there])]
        arrays += [pa.array(x[there]) for x in (*ints, *floats)]
        return pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "held_out", *_INTS, *_DocumentSums.fractions])

    parts, current = [], None
    for batch in batches:
        for i in range(batch.num_rows):
            group = batch.column(1)[i].as_py()
            if group != current and parts:
                yield whole(current, parts)
                parts = []
            current = group
            parts.append((batch.column(0)[i].as_py(), batch.column(2)[i].as_py()))
    if parts:
        yield whole(current, parts)


@dataclass
class _Blob:
    """The pairs of a batch in one bucket, in the order of ``major``: the words, or the histories of heavy words."""

    base: int
    heavy: bool
    major: np.ndarray
    per_major: np.ndarray
    minor: np.ndarray
    where: np.ndarray
    trained: np.ndarray
    holders: np.ndarray
    docs: np.ndarray
    times: np.ndarray
    word_count: np.ndarray | None = None
    found: list[np.ndarray] = field(default_factory=list)

    def pair_counts(self) -> np.ndarray:
        return np.concatenate(self.found)

    def pairs(self, lowest: int = 0, highest: int = (1 << 64) - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words, histories, training counts and words' counts of the pairs whose ``major`` lies in a range of hashes."""
        i, j = np.searchsorted(self.major, np.uint64(lowest)), np.searchsorted(self.major, np.uint64(highest), "right")
        each = self.per_major[i:j].astype(np.int64)
        p = int(self.per_major[:i].sum(dtype=np.int64))
        where = self.where[p : p + int(each.sum())]
        sides = np.repeat(self.major[i:j], each), self.minor[where]
        counts = self.word_count[where] if self.heavy else np.repeat(self.word_count[i:j], each)
        w, h = reversed(sides) if self.heavy else sides
        return w, h, self.trained[p : p + len(where)].astype(np.int64), counts


def _count_buckets(pairs_too: bool, frequent: _Frequent):
    """A task has one bucket: all pairs of its words, and the pairs of heavy words that are dealt to it.  Pairs are counted in ranges
    of hashes, then documents are summed batch after batch, so that only the unpacked rows, in narrow types, are held as
    a whole.  Sums leave the task in parts."""

    def home(keys: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
        return np.flatnonzero(keys % np.uint64(buckets) == np.uint64(bucket))

    def count(blobs: list[_Blob], heavy: np.ndarray, hot: np.ndarray, histories: _Sums):
        cold = [blob for blob in blobs if not blob.heavy]
        if cold:
            sums = [np.add.reduceat(x.trained.astype(np.int64), np.cumsum(x.per_major, dtype=np.int64) - x.per_major) for x in cold]
            names, at = np.unique(np.concatenate([x.major for x in cold]), return_inverse=True)
            word_count = _sum(at, len(names), np.concatenate(sums)).astype(np.int64)
            yield from _word_totals(word_count)
            for x, own in zip(cold, np.split(at, np.cumsum([len(x.major) for x in cold])[:-1]), strict=True):
                x.word_count = _narrow(word_count[own])
        for x in blobs:
            if x.heavy:
                x.word_count = heavy[np.searchsorted(frequent.heavy, x.minor)]
        slices = max(1, -(-24 * sum(len(x.where) for x in blobs) // SLICE_BYTES))
        for k in range(slices):
            lowest, highest = (k << 64) // slices, ((k + 1 << 64) // slices) - 1
            parts = [x.pairs(lowest, highest) for x in blobs]
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            counts = yield from _count_pairs(*columns, pairs_too, histories, frequent.hot, hot)
            for x, own in zip(blobs, np.split(counts, np.cumsum([len(part[0]) for part in parts])[:-1]), strict=True):
                x.found.append(_narrow(own))

    def sum_documents(blobs: list[_Blob], documents: _Sums):
        blobs.sort(key=lambda x: x.base)
        for run in _runs(blobs, lambda x: 40 * (len(x.docs) + len(x.where)), SLICE_BYTES):
            w, h, _, wc = (np.concatenate(c) for c in zip(*(x.pairs() for x in run), strict=True))
            # Documents of a run, one batch beside the other.
            spans: dict[int, int] = {}
            for x in run:
                spans[x.base] = max(spans.get(x.base, 0), int(x.docs.max()) + 1)
            firsts = dict(zip(spans, np.cumsum([0, *spans.values()])[:-1].tolist(), strict=True))
            own = np.concatenate([np.arange(base, base + n) for base, n in spans.items()])
            at = np.concatenate([x.docs.astype(np.int64) + firsts[x.base] for x in run])
            holders, times = (np.concatenate(c) for c in zip(*((x.holders, x.times) for x in run), strict=True))
            yield from _sum_documents(w, h, np.concatenate([x.pair_counts() for x in run]), wc, holders, own, at, times, documents)

    def run(batches):
        blobs: list[_Blob] = []
        heavy, hot = np.zeros(len(frequent.heavy), np.int64), np.zeros(len(frequent.hot), np.int64)
        bucket, buckets = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                base, holds = (batch.column(k)[i].as_py() for k in (1, 2))
                data = batch.column(4)[i].as_buffer()  # lies in the batch, not beside it
                if holds == _META:
                    flags = np.frombuffer(batch.column(3)[i].as_py(), dtype="u1").astype(bool)
                    n = len(flags)
                    ids = np.frombuffer(data, dtype="<i8", count=n)
                    null = np.frombuffer(data, dtype="u1", offset=8 * n)
                    yield from _group_rows("m", base + np.arange(n), ids, null, (~flags).view("u1"))
                elif holds == _TOTALS:
                    bucket, buckets = batch.column(0)[i].as_py(), base
                    for total, more in zip((heavy, hot), _unblob(data, 2, "ii"), strict=True):
                        total += more
                else:
                    blobs.append(_Blob(base, holds == _HEAVY, *_unpacked(data, frequent.common)))
        if bucket is None:
            return
        histories = _Sums(SUM_ROWS)
        # A heavy word's totals and a hot pair's are told by one bucket.
        own = home(mix64(frequent.heavy), bucket, buckets)
        yield from _rows("e", own, n_known=frequent.heavy[own].view(np.int64), n_tokens=heavy[own])
        own = home(frequent.hot, bucket, buckets)
        words = frequent.hot_words[own]
        word_count = heavy[np.searchsorted(frequent.heavy, words)]
        yield from _pair_totals(words, frequent.hot_histories[own], hot[own], word_count, pairs_too, histories)
        if blobs:
            yield from count(blobs, heavy, hot, histories)
            yield from histories.rows("h")
            documents = _DocumentSums(SUM_ROWS // 4)
            yield from sum_documents(blobs, documents)
            yield from documents.rows("d")
        else:
            yield from histories.rows("h")

    return run


def _word_totals(word_count: np.ndarray):
    """Counts of counts of words."""
    classes = np.bincount(np.minimum(word_count, K + 2), minlength=K + 3)
    totals = {c: classes[r : r + 1] for r, c in enumerate([*_UNSEEN, "n_unknown_unseen"], 1)}
    totals |= {"n_tokens": word_count.sum(keepdims=True), "n_known": (word_count > 0).sum(keepdims=True)}
    yield from _rows("s", np.zeros(1), **totals, sum_word=(word_count > K).sum(keepdims=True))


def _pair_totals(words, histories, pair_count, word_count, pairs_too: bool, history_sums: _Sums):
    """Counts of counts of distinct pairs, and what their histories need: those of the pairs seen after them, and of those
    pairs' words."""
    seen = pair_count > 0
    words, histories, pair_count, word_count = words[seen], histories[seen], pair_count[seen], word_count[seen]
    if not len(words):
        return
    classes = np.bincount(np.minimum(pair_count, K + 2), minlength=K + 3)
    yield from _rows("s", np.zeros(1), **{c: classes[r : r + 1] for r, c in enumerate([*_CLASSES, "n_tail"], 1)})
    names, at = np.unique(histories, return_inverse=True)
    n = len(names)
    columns = {"n_tokens": _sum(at, n, pair_count), "sum_word": _sum(at, n, np.where(word_count > K, word_count, 0))}
    for kinds, counts in (([*_CLASSES, "n_tail"], pair_count), ([*_UNSEEN, "n_unknown_unseen"], word_count)):
        table = np.bincount(at * (K + 1) + np.minimum(counts, K + 1) - 1, minlength=n * (K + 1)).reshape(n, K + 1)
        columns |= dict(zip(kinds, table.T, strict=True))
    yield from history_sums.room("h", n)
    history_sums.add(names.view(np.int64), columns)
    if pairs_too:
        yield from _rows("p", histories.view(np.int64), other=words.view(np.int64), n_tokens=pair_count)


def _count_pairs(words, histories, counts, word_count, pairs_too: bool, history_sums: _Sums, hot: np.ndarray, hot_counts: np.ndarray):
    """The whole count of each packed pair.  Those of hot pairs are known."""
    keys = _pair_keys(words, histories)
    order = np.argsort(keys)
    keys = keys[order]
    starts = _starts(keys)
    pair_count = np.add.reduceat(counts[order], starts) if len(starts) else np.empty(0, np.int64)
    known, at = _places(hot, keys[starts])
    pair_count[known] = hot_counts[at]
    first = order[starts[~known]]
    yield from _pair_totals(words[first], histories[first], pair_count[~known], word_count[first].astype(np.int64), pairs_too, history_sums)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(pair_count, _lengths(starts, len(order)))
    return out


def _sum_documents(words, histories, pair_count, word_count, holders, own, at, times, documents: _Sums):
    """Sums of documents and their unseen pairs.  Documents are places ``at`` among ``own``."""
    pair_count, word_count = pair_count.astype(np.int64), word_count.astype(np.int64)
    seen, known = pair_count > 0, word_count > 0
    of_pair = np.minimum(pair_count, K + 1) - 1
    of_word = K + 1 + np.minimum(word_count, K + 1) - 1
    n_kinds = 2 * K + 3
    kinds = np.where(seen, of_pair, np.where(known, of_word, n_kinds - 1))
    taken = np.where(seen, pair_count, np.where(known, word_count, 1))
    logs = np.log10(taken - np.where((taken > K) & known, TAIL, 0.0))
    logs -= np.where(known & (words != END), np.log10(np.maximum(word_count, 1)), 0.0)  # the end is no history
    pair, n, weights = np.repeat(np.arange(len(words)), holders), len(own), times.astype(float)
    table = _sum(at * n_kinds + kinds[pair], n * n_kinds, weights).reshape(n, n_kinds)
    there = np.flatnonzero(table.any(axis=1))
    base_log, score_log = (_sum(at, n, weights * x[pair])[there] for x in (np.log10(word_count + 1.0), logs))
    table = table[there].T
    columns = {"n_tokens": table.sum(axis=0), "n_known": table[:-1].sum(axis=0), "n_tail": table[: K + 1].sum(axis=0)}
    columns |= dict(zip(_CLASSES, table, strict=False)) | dict(zip(_UNSEEN, table[K + 1 :], strict=False))
    columns |= {"n_unknown_unseen": table[-1], "base_log": base_log, "score_log": score_log}
    yield from documents.room("d", len(there))
    documents.add(own[there], columns)
    pick = np.flatnonzero(~seen[pair])
    yield from _rows("u", histories[pair[pick]].view(np.int64), other=own[at[pick]], n_tokens=times[pick])


def _merge(words, histories, counts, holders, docs, times, pairs_too: bool, documents: _Sums, history_sums: _Sums):
    """Words whose pairs are all there, in one slice and run."""
    names, at = np.unique(words, return_inverse=True)
    word_count = _sum(at, len(names), counts).astype(np.int64)
    yield from _word_totals(word_count)
    none = np.empty(0, np.uint64)
    pair_count = yield from _count_pairs(words, histories, counts.astype(np.int64), word_count[at], pairs_too, history_sums, none, none)
    own, place = np.unique(docs, return_inverse=True)
    yield from _sum_documents(words, histories, pair_count, word_count[at], holders, own, place, times, documents)


def discounts(counts_of_counts: list[int]) -> list[float]:
    """Good-Turing ratios d(1) .. d(K) from n(1) .. n(K + 1); where the counts are too thin, half a count is taken."""
    n = [0, *counts_of_counts]
    limit = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (n[r] * r) - limit) / (1 - limit) if n[r] and limit < 1 else 1.0
        out.append(d if 0 < d < 1 else 1 - 0.5 / r)
    return out


@dataclass(frozen=True)
class KatzModel:
    """``scores``: one row per document.  ``histories``: backoff weight of each history.  ``pairs``: their counts (if
    stored).  The discounts of pairs and words, ``unknown`` (the mass of unknown words), N and V."""

    scores: DataFrame
    histories: DataFrame
    pairs: DataFrame
    pair_discounts: list[float]
    word_discounts: list[float]
    unknown: float
    tokens: int
    types: int


def _weighted(columns: list[str], values: list[float]) -> Column:
    total = F.lit(0.0)
    for c, v in zip(columns, values, strict=True):
        total = total + F.col(c) * F.lit(float(v))
    return total


def katz_scores(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, held_out: int = 2, pairs: bool = False
) -> KatzModel:
    """Learns from the documents whose crc32 of the id leaves another remainder, and scores all of them."""
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    train = crc32_remainder(doc_id, modulus) != held_out
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), train.alias("train"), text_or_empty(text).alias("text"))
    frequent = _sampled(rows, buckets)
    packed = rows.mapInArrow(_pack(buckets, frequent), "bucket int, base long, holds int, train binary, data binary")
    dealt = packed.repartitionById(buckets, "bucket")
    parts = stage_table(dealt.mapInArrow(_count_buckets(pairs, frequent), _SCHEMA), "katz")

    known = [r.n_tokens for r in parts.filter("kind = 'e' AND n_tokens > 0").select("n_tokens").collect()]
    heavy_totals = {c: known.count(r) for r, c in enumerate([*_UNSEEN, "n_unknown_unseen"], 1)}
    heavy_totals |= {"n_tokens": sum(known), "n_known": len(known), "sum_word": sum(c > K for c in known)}
    s = parts.filter("kind = 's'").agg(*[F.sum(c).alias(c) for c in [*_INTS, "sum_word"]]).first().asDict()
    s = {c: (n or 0) + heavy_totals.get(c, 0) for c, n in s.items()}
    n_pairs = [s[c] or 0 for c in _CLASSES] + [s["n_tail"] or 0]
    n_words = [s[c] or 0 for c in _UNSEEN] + [s["n_unknown_unseen"] or 0]
    tokens, types, tail_words = s["n_tokens"] or 0, s["n_known"] or 0, s["sum_word"] or 0
    pair_d, word_d = discounts(n_pairs), discounts(n_words)
    total = max(tokens, 1)
    unknown = (sum((1 - d) * r * n_words[r - 1] for r, d in enumerate(word_d, 1)) + TAIL * tail_words) / total if tokens else 1.0

    # The weights follow from three sums, so only these are dealt by history.
    found = parts.filter("kind = 'h'").na.fill(0)
    left = _weighted(_CLASSES, [(1 - d) * r for r, d in enumerate(pair_d, 1)]) + TAIL * F.col("n_tail")
    lower = _weighted(_UNSEEN, [d * r for r, d in enumerate(word_d, 1)]) + F.col("sum_word") - TAIL * F.col("n_unknown_unseen")
    summed = found.select("key", "n_tokens", left.alias("left"), lower.alias("lower")).groupBy("key")
    histories = summed.agg(*[F.sum(c).alias(c) for c in ("n_tokens", "left", "lower")]).select(
        F.col("key").alias("history"),
        F.col("n_tokens").alias("count"),
        (F.col("left") / F.col("n_tokens") / (1 - F.col("lower") / F.lit(float(total)))).alias("backoff"),
    )
    unseen = (
        parts.filter("kind = 'u'")
        .select(F.col("key").alias("history"), F.col("other").alias("row"), "n_tokens")
        .join(histories, "history")
        .select("row", (F.col("n_tokens") * (F.log10("count") + F.log10("backoff"))).alias("backed"))
    )
    # The start counts as a history of every document.
    starts = histories.filter(F.col("history") == int(START)).agg(F.max("count")).first()[0] or 0
    kinds = ", ".join([*(f"{c} long" for c in _INTS), *(f"{c} double" for c in _DocumentSums.fractions)])
    groups = parts.filter("kind IN ('d', 'm')").select("kind", "key", "data").repartition("key").sortWithinPartitions("key")
    documents = groups.mapInArrow(_sum_groups, f"row long, doc_id long, held_out boolean, {kinds}")
    backed = unseen.groupBy("row").agg(F.sum("backed").alias("backed"))
    seen = _weighted(_CLASSES, [math.log10(d) for d in pair_d])
    n_unseen_words = F.col("n_tokens") - F.col("n_seen_tokens") - F.col("n_unknown_unseen")
    below = (
        _weighted(_UNSEEN, [math.log10(d) for d in word_d])
        - n_unseen_words * F.lit(math.log10(total))
        + F.col("n_unknown_unseen") * F.lit(math.log10(unknown))
    )
    first = F.lit(math.log10(starts) if starts else 0.0)
    base = F.col("base_log") - F.col("n_tokens") * F.lit(math.log10(tokens + types + 1))
    scores = (
        documents.withColumn("n_seen_tokens", F.col("n_tail"))
        .join(backed, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(tokens).cast("long").alias("train_tokens"),
            base.alias("base_score"),
            (F.col("score_log") + seen + below - first + F.coalesce("backed", F.lit(0.0))).alias("score"),
        )
    )
    stored = parts.filter("kind = 'p'").select(
        F.col("key").alias("history"), F.col("other").alias("word"), F.col("n_tokens").alias("count")
    )
    return KatzModel(scores, histories, stored, pair_d, word_d, unknown, tokens, types)
