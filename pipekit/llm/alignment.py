"""Alignment of two tokenizers by an associative fragment of token groups.

Token ends that both tokenizers share cut a text into groups.  A *fragment* of a byte range is the list of its group
sizes (tokens of each tokenizer): the first group is open to the left, the last one open to the right, those between
are closed.  Two neighbouring fragments compose by adding the left one's last group to the right one's first; a range
without a shared end is a single group, open on both sides.  Composition is associative, so fragments of a very long
document compose in any tree order.

Documents of at most ``LONG_BYTES`` are one fragment, made where they are read.  Longer ones are cut into chunks (only
where both tokenizers surely end a token: at a single space between two other characters), the chunks are dealt over
tasks, each task cuts its tokens at every ``RANGE_BYTES`` of the document, whatever group that falls into, and the
fragments are composed ``FAN_IN`` at a time, level by level.  A text without such a space is one chunk.

The last tokens of a group are linked.  Links are kept per *block* of documents (at most ``BLOCK_BYTES`` of text) as ranks
among the block's packed pairs of ids; counting shuffles one row per block and distinct pair, not one per link, so that
even the most frequent pair is one row of the many thousands that a block has.  Only the highest count per B id is
broadcast, at most a row per vocabulary entry.  A block's counts come back to its links, one block at a time.

Texts that are NULL, empty, or not reproduced byte for byte have no tokens (A's vocabulary is of bytes and reproduces any).  Repeated rows each
count, a NULL ``doc_id`` stays NULL, other columns are ignored, an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipekit.llm.common import stage_table, text_or_empty
from pipekit.llm.token_cache import load_ranks

LONG_BYTES = 64 * 1024
RANGE_BYTES = 16 * 1024
FAN_IN = 8
BLOCK_BYTES = 2 * 1024 * 1024
#: Text whose tokens are aligned at once, and pieces that a Python worker keeps (as many again of the generation before):
#: they bound memory, never the result.
STEP_BYTES = 512 * 1024
MEMO_PIECES = 120_000
PIECES_AT_ONCE = 10_000
#: Pieces up to this many characters are kept.
MEMO_LENGTH = 64

#: A space between two characters that are not white space.  No entry of either vocabulary goes on over it, so both
#: tokenizers end a token before it.
CUT = re.compile(r" (?<=\S )(?=\S)")

PAIR_BITS = 15  # of the B id in a packed pair, which has 32 in all


# ---------------------------------------------------------------- the monoid


@dataclass(frozen=True)
class Fragment:
    """Tokens of a byte range: ids of both tokenizers, group sizes of both, and whether the bytes were right."""

    a: np.ndarray
    b: np.ndarray
    sizes_a: np.ndarray
    sizes_b: np.ndarray
    valid: bool = True

    def __add__(self, other: Fragment) -> Fragment:
        def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            return np.concatenate([left[:-1], [left[-1] + right[0]], right[1:]])

        return Fragment(
            np.concatenate([self.a, other.a]),
            np.concatenate([self.b, other.b]),
            join(self.sizes_a, other.sizes_a),
            join(self.sizes_b, other.sizes_b),
            self.valid and other.valid,
        )

    def closed(self) -> tuple[np.ndarray, np.ndarray]:
        """Group sizes of a whole text: it starts and ends at a shared end, so the last open group is empty."""
        return self.sizes_a[:-1], self.sizes_b[:-1]


EMPTY = Fragment(*[np.zeros(0, dtype=np.int32)] * 2, *[np.zeros(1, dtype=np.int64)] * 2)


def compose(fragments: list[Fragment]) -> Fragment:
    """The sum of neighbouring fragments, as a balanced tree."""
    while len(fragments) > 1:
        fragments = [reduce(Fragment.__add__, fragments[i : i + 2]) for i in range(0, len(fragments), 2)]
    return fragments[0] if fragments else EMPTY


def groups(ends_a: np.ndarray, ends_b: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Group sizes of a byte range from the tokens' ends in it (1 to ``length``, ascending)."""
    marks = np.zeros(length + 1, dtype=bool)
    marks[ends_a] = True
    shared = ends_b[marks[ends_b]]
    at_a = np.concatenate([[0], np.searchsorted(ends_a, shared, "right"), [len(ends_a)]])
    at_b = np.concatenate([[0], np.searchsorted(ends_b, shared, "right"), [len(ends_b)]])
    return np.diff(at_a), np.diff(at_b)


def fragments_at(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, cuts: list[int]) -> list[Fragment]:
    """One fragment per byte range between neighbouring ``cuts``, of the tokens that end in it."""
    out = []
    for start, end in zip(cuts, cuts[1:]):
        i, j = np.searchsorted(ends_a, [start, end], "right")
        k, m = np.searchsorted(ends_b, [start, end], "right")
        sizes = groups(ends_a[i:j] - start, ends_b[k:m] - start, end - start)
        out.append(Fragment(a[i:j], b[k:m], *sizes))
    return out


# ---------------------------------------------------------------- tokens


class Aligned(NamedTuple):
    """A closed fragment, rendered: numbers of tokens and groups, the groups as text, and their packed links."""

    n_a: int
    n_b: int
    n_groups: int
    text: str
    links: bytes


class TwoTokenizers:
    """Tokens of both vocabularies.  Pieces between cuts are encoded on their own; both tokenizers end a token with each, so
    a text's fragment is the sum of its pieces' closed ones, and known pieces are aligned once."""

    def __init__(self, ranks: str, pieces: str) -> None:
        import sentencepiece

        self.a, self.b = load_ranks(ranks), sentencepiece.SentencePieceProcessor(model_file=pieces)
        a_bytes = [b""] * self.a.n_vocab
        with open(ranks, "rb") as lines:
            for token, rank in map(bytes.split, lines):
                a_bytes[int(rank)] = base64.b64decode(token)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_sizes = np.array([len(t) for t in a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        # Each id as text: A's within its list and as its last one, then B's, and B's as the last one of a text.
        lists = [(a_bytes, ","), (a_bytes, "|"), (self.b_bytes, ","), (self.b_bytes, ";"), (self.b_bytes, "\n")]
        self.names = [f"{i}{end}" for ids, end in lists for i in range(len(ids))]
        self.known: dict[str, Aligned | None] = {}
        self.before: dict[str, Aligned | None] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _encode(self, pieces: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of each piece, None where B does not give its bytes back (A, of bytes, always does)."""
        spaced, b_of = [f" {piece}" for piece in pieces], self.b_bytes.__getitem__
        ids_a = list(map(self.a.encode_ordinary, spaced))
        ids_b = self.b.encode(pieces, num_threads=1)
        right = [b"".join(map(b_of, b)) == piece.encode() for piece, b in zip(spaced, ids_b, strict=True)]
        return [(a, b) if ok else None for a, b, ok in zip(ids_a, ids_b, right, strict=True)]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a text by A and B, None if it has no tokens.  A space is put before it."""
        pieces = CUT.split(text) if text else []
        each = dict(zip(names := sorted(set(pieces)), self._encode(names), strict=True))
        ids = [each[piece] for piece in pieces]
        if not ids or None in ids:
            return None
        a, b = zip(*ids)
        return tuple(np.array(list(chain.from_iterable(x)), dtype=np.int32) for x in (a, b))

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])

    def fragment(self, text: str) -> Fragment | None:
        """A whole text's fragment, in one piece."""
        found = self.tokens(text)
        if found is None:
            return None
        ends = self.ends(*found)
        return Fragment(*found, *groups(*ends, int(ends[0][-1])))

    def ranges(self, text: str, start: int) -> list[Fragment]:
        """Fragments of a chunk that starts at a byte of its document: a new one at every ``RANGE_BYTES``."""
        found = self.tokens(text)
        if found is None:
            return [Fragment(EMPTY.a, EMPTY.b, EMPTY.sizes_a, EMPTY.sizes_b, valid=False)]
        ends = self.ends(*found)
        length = int(ends[0][-1])
        first = RANGE_BYTES - start % RANGE_BYTES
        return fragments_at(*found, *ends, [0, *range(first, length, RANGE_BYTES), length])

    def rendered(self, fragments: list[Fragment]) -> list[Aligned]:
        """Whole texts' fragments with their groups as ``a1,a2|b1;a3|b2`` and their links."""
        closed = [f.closed() for f in fragments]
        sizes = [np.concatenate([c[i] for c in closed]) for i in (0, 1)]
        ids = [np.concatenate([getattr(f, x) for f in fragments]) for x in ("a", "b")]
        counts = [[len(getattr(f, x)) for f in fragments] for x in ("a", "b")]
        return self._render(*ids, *sizes, *counts, np.array([len(c[0]) for c in closed]))

    def _render(self, a, b, sizes_a, sizes_b, counts_a, counts_b, n_groups: np.ndarray) -> list[Aligned]:
        """The same of many texts at once: their ids and group sizes one after another, their numbers of tokens and groups."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        packed = ((a[ends_a - 1] << PAIR_BITS) | b[ends_b - 1]).astype("<u4").tobytes()
        last = np.cumsum(n_groups)
        b += 2 * len(self.a_sizes)
        a[ends_a - 1] += len(self.a_sizes)
        b[ends_b - 1] += len(self.b_sizes)
        b[ends_b[last - 1] - 1] += len(self.b_sizes)
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[np.arange(len(a)) + np.repeat(ends_b - sizes_b, sizes_a)] = a
        codes[np.arange(len(b)) + np.repeat(ends_a, sizes_b)] = b
        texts = "".join(map(self.names.__getitem__, codes.tolist())).split("\n")
        cuts = [0, *(4 * last).tolist()]
        links = [packed[start:end] for start, end in zip(cuts, cuts[1:])]
        return list(map(Aligned._make, zip(counts_a, counts_b, n_groups.tolist(), texts, links)))

    def forget(self) -> None:
        """Drops the known pieces.  A worker outlives its task: what it keeps would lie beside the stages that follow."""
        self.known, self.before = {}, {}

    def _align_pieces(self, pieces: list[str]) -> list[Aligned | None]:
        """Pieces, each aligned on its own; their tokens are worked on together."""
        encoded = self._encode(pieces)
        some = [ids for ids in encoded if ids is not None]
        if not some:
            return [None] * len(pieces)
        of_a, of_b = zip(*some)
        counts_a, counts_b = list(map(len, of_a)), list(map(len, of_b))
        a, b = (np.fromiter(chain.from_iterable(x), dtype=np.int32) for x in (of_a, of_b))
        ends = self.ends(a, b)
        sizes_a, sizes_b = groups(*ends, int(ends[0][-1]))
        # Each piece ends at a shared end: its groups are those up to its last token.  Nothing follows the last piece.
        sizes_a, sizes_b = sizes_a[:-1], sizes_b[:-1]
        last = np.searchsorted(np.cumsum(sizes_a), np.cumsum(counts_a), "left") + 1
        found = iter(self._render(a, b, sizes_a, sizes_b, counts_a, counts_b, np.diff(last, prepend=0)))
        return [None if ids is None else next(found) for ids in encoded]

    def align(self, texts: list[str]) -> list[Aligned | None]:
        """Whole texts, None without tokens."""
        split = [CUT.split(text) if text else [] for text in texts]
        if len(self.known) > MEMO_PIECES:
            self.before, self.known = self.known, {}
        wanted = set(chain.from_iterable(split)).difference(self.known)
        # Pieces of the generation before that are met again stay; the others go with it.
        kept = wanted.intersection(self.before)
        self.known.update((piece, self.before[piece]) for piece in kept)
        new = list(wanted.difference(kept))
        for at in range(0, len(new), PIECES_AT_ONCE):
            some = new[at : at + PIECES_AT_ONCE]
            self.known.update(zip(some, self._align_pieces(some), strict=True))
        out: list[Aligned | None] = []
        for pieces in split:
            rows = list(map(self.known.__getitem__, pieces))
            if not rows or None in rows:
                out.append(None)
            else:
                n_a, n_b, n_groups, text, links = zip(*rows)
                out.append(Aligned(sum(n_a), sum(n_b), sum(n_groups), ";".join(text), b"".join(links)))
        for piece in new:
            if len(piece) > MEMO_LENGTH:
                del self.known[piece]
        return out


_PAIRS: dict[tuple[str, str], TwoTokenizers] = {}


def two_tokenizers(ranks: str, pieces: str) -> TwoTokenizers:
    if (ranks, pieces) not in _PAIRS:
        _PAIRS[ranks, pieces] = TwoTokenizers(ranks, pieces)
    return _PAIRS[ranks, pieces]


# ---------------------------------------------------------------- blocks of documents

_BLOCK = (
    "block string, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, digests array<string>, "
    "links binary, pairs array<long>, counts array<long>"
)


class _Block:
    """Documents whose links are counted together."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.parts: list[bytes] = []
        self.bytes = 0

    def add(self, doc_id: int | None, found: Aligned | None, size: int) -> None:
        self.bytes += size
        if found is None:
            self.rows.append((doc_id, 0, 0, 0, ""))
        else:
            digest = hashlib.sha256(found.text.encode()).hexdigest()
            self.rows.append((doc_id, found.n_a, found.n_b, found.n_groups, digest))
            self.parts.append(found.links)

    def batch(self) -> pa.RecordBatch:
        found = np.frombuffer(b"".join(self.parts), dtype="<u4")
        code, pairs = pd.factorize(found)
        order = np.argsort(pairs)
        # A block's links are its largest part by far, in one row: two bytes each as long as the ranks fit.
        rank = np.empty(len(order), dtype="<u2" if len(order) <= 1 << 16 else "<u4")
        rank[order] = np.arange(len(order))
        counts = np.bincount(code, minlength=len(pairs))[order]
        columns = [list(c) for c in zip(*self.rows)]
        values = [str(uuid.uuid4()), *columns, rank[code].tobytes(), pairs[order].astype(np.int64), counts]
        kinds = [pa.string(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.binary(), *[pa.list_(pa.int64())] * 2]
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def _blocks(ranks: str, pieces: str):
    """Whole documents to blocks."""

    def run(batches):
        pair, block, unused = two_tokenizers(ranks, pieces), _Block(), pa.default_memory_pool().release_unused
        for batch in batches:
            ids, sizes, at = batch.column(0), batch.column(2).to_numpy(), 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 4096]), STEP_BYTES)))
                texts = batch.column(1).slice(at, n).to_pylist()
                for doc_id, found, size in zip(ids.slice(at, n).to_pylist(), pair.align(texts), sizes[at : at + n]):
                    block.add(doc_id, found, int(size))
                at += n
                if block.bytes >= BLOCK_BYTES:
                    yield block.batch()
                    block = _Block()
                    unused()  # Arrow keeps the room of the batches that went by
        pair.forget()
        if block.rows:
            yield block.batch()
        unused()

    return run


# ---------------------------------------------------------------- long documents

_CHUNK = "doc string, doc_id long, seq long, start long, text string"
_FRAGMENT = "doc string, doc_id long, seq long, valid boolean, a binary, b binary, sizes_a binary, sizes_b binary"


def chunks(text: str, size: int) -> list[tuple[int, str]]:
    """(first byte, text) of the chunks: each ends at the first cut past ``size`` characters, or with the text.  The space
    at a cut starts the next chunk, where the tokenizers put it back; so the bytes are those of space and text."""
    out, start, place = [], 0, 0
    while start < len(text):
        cut = CUT.search(text, start + size)
        end = cut.start() if cut else len(text)
        part = text[start:end]
        out.append((place, part))
        place += len(part.encode()) + 1
        start = end + 1
    return out


def _chunks(size: int):
    def run(batches):
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc = str(uuid.uuid4())
                for seq, (start, part) in enumerate(chunks(text.as_py(), size)):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc": [doc],
                            "doc_id": pa.array([doc_id], pa.int64()),
                            "seq": pa.array([seq], pa.int64()),
                            "start": pa.array([start], pa.int64()),
                            "text": [part],
                        }
                    )

    return run


def _pack(doc: str, doc_id: int | None, seq: int, f: Fragment) -> pa.RecordBatch:
    values = [doc, doc_id, seq, f.valid, *[x.astype("<i4").tobytes() for x in (f.a, f.b, f.sizes_a, f.sizes_b)]]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 4]
    names = [c.split()[0] for c in _FRAGMENT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)


def _unpack(row: dict) -> Fragment:
    arrays = [np.frombuffer(row[c], dtype="<i4") for c in ("a", "b", "sizes_a", "sizes_b")]
    return Fragment(arrays[0], arrays[1], arrays[2].astype(np.int64), arrays[3].astype(np.int64), row["valid"])


def _ranges(ranks: str, pieces: str):
    def run(batches):
        pair = two_tokenizers(ranks, pieces)
        for batch in batches:
            for doc, doc_id, seq, start, text in zip(*[batch.column(i) for i in range(5)]):
                found = compose(pair.ranges(text.as_py(), start.as_py()))
                yield _pack(doc.as_py(), doc_id.as_py(), seq.as_py(), found)

    return run


def _compose_level(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["seq"])
    whole = compose([_unpack(r) for r in rows])
    first = rows[0]
    return pa.Table.from_batches([_pack(first["doc"], first["doc_id"], first["seq"] // FAN_IN, whole)])


def _whole_block(ranks: str, pieces: str):
    """The tree's last level: a document's fragments to its block."""

    def run(table: pa.Table) -> pa.Table:
        (row,) = _compose_level(table).to_pylist()
        block, fragment = _Block(), _unpack(row)
        block.add(row["doc_id"], two_tokenizers(ranks, pieces).rendered([fragment])[0] if fragment.valid else None, 0)
        return pa.Table.from_batches([block.batch()])

    return run


def _tree(docs: DataFrame, ranks: str, pieces: str, chunk: int) -> DataFrame:
    """Fragments of ``docs`` (``doc_id``, ``text``), composed over tasks until a document has ``FAN_IN`` at most."""
    # Written, so that a chunk and its document's name stay together when a task is run again.
    cut = stage_table(docs.select("doc_id", "text").mapInArrow(_chunks(chunk), _CHUNK), "chunks")
    most = cut.agg(F.max("seq")).first()[0] or 0
    tree = cut.repartition("doc", "seq").mapInArrow(_ranges(ranks, pieces), _FRAGMENT)
    while most >= FAN_IN:
        tree = tree.groupBy("doc", F.floor(F.col("seq") / FAN_IN)).applyInArrow(_compose_level, _FRAGMENT)
        most //= FAN_IN
    return tree


def long_fragments(docs: DataFrame, ranks: str, pieces: str, chunk: int = LONG_BYTES) -> DataFrame:
    """One whole fragment per row of ``docs``."""
    return _tree(docs, ranks, pieces, chunk).groupBy("doc").applyInArrow(_compose_level, _FRAGMENT)


def long_blocks(docs: DataFrame, ranks: str, pieces: str, chunk: int = LONG_BYTES) -> DataFrame:
    """One block per row of ``docs``.  A task runs one Python function: each further one would be a worker more, that holds its
    tokenizers and takes its turn with the short documents' pieces as long as the executor lives."""
    return _tree(docs, ranks, pieces, chunk).groupBy("doc").applyInArrow(_whole_block(ranks, pieces), _BLOCK)


# ---------------------------------------------------------------- counts

_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _count_back(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's documents with the corpus-wide counts of its pairs, which ``links`` names by their rank."""
    row = left.to_pylist()[0]
    order = np.argsort(right["pair"].to_numpy())
    n, best = right["n"].to_numpy()[order], right["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
    if len(n) != row["n_pairs"]:
        raise RuntimeError(f"a block has {row['n_pairs']} pairs and {len(n)} counts")
    place = np.frombuffer(row["links"], dtype="<u2" if row["n_pairs"] <= 1 << 16 else "<u4").astype(np.int64)
    ends = np.cumsum(np.array(row["n_groups"], dtype=np.int64))
    starts = ends - np.array(row["n_groups"], dtype=np.int64)

    def sums(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values[place] if len(place) else np.zeros(0, dtype=np.int64))])
        return total[ends] - total[starts]

    columns = [row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], row["n_groups"], sums(best), sums(n), row["digests"]]
    names = [c.split()[0] for c in _RESULT.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, n, best``: links that hold each pair, and whether no A id has more with its B id."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    counts = stage_table(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1)
    highest = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # at most a row per vocabulary entry
    joined = counts.withColumn("b", b).join(F.broadcast(highest), "b")
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(
    docs: DataFrame, ranks: str, pieces: str, *, doc_id: str = "doc_id", text: str = "text", long_bytes: int = LONG_BYTES
) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``ranks`` is the rank form of tokenizer A's byte-level vocabulary, ``pieces`` tokenizer B's model."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    size = F.octet_length("text")
    short = rows.filter(size <= long_bytes).select("doc_id", "text", size.alias("size")).mapInArrow(_blocks(ranks, pieces), _BLOCK)
    whole = long_blocks(rows.filter(size > long_bytes), ranks, pieces, long_bytes)
    blocks = stage_table(short.unionByName(whole), "blocks")
    counts = stage_table(pair_counts(blocks), "pairs")
    wanted = blocks.select("block", F.explode("pairs").alias("pair"))
    back = wanted.hint("merge").join(counts, "pair")
    rows = blocks.select(F.col("block").alias("owner"), "doc_ids", "n_a", "n_b", "n_groups", "digests", "links", F.size("pairs").alias("n_pairs"))
    return rows.groupBy("owner").cogroup(back.groupBy("block")).applyInArrow(_count_back, _RESULT)
