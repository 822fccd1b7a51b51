"""BPE encoding with a segment tree over adjacent pair ranks, and decoding.

A word is split into its smallest symbols.  The leaves of a segment tree hold the merge rank of each adjacent pair (and
its place, so that equal ranks are taken from the left); the root is the leftmost pair of lowest rank.  A merge changes
at most three leaves, each updated on its way to the root, until the root holds no pair.  Words of up to ``SHORT``
symbols are merged side by side, one tree per row of an array; longer ones have a tree of their own, so that a run of a
million letters takes n log n steps.

Texts are mapped where they lie: nothing is shuffled, and a task keeps the ids of at most ``MEMO_WORDS`` known words.
NULL is the empty text: no token, both digests those of the empty string.  Repeated rows give equal rows, a NULL
``doc_id`` stays NULL, other columns are ignored, an empty table gives an empty one.  The special strings of the
vocabulary inside a text are their own tokens, as by the library's default.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipekit.llm.common import text_or_empty
from pipekit.llm.token_cache import load_tokenizer

#: Longest word, in symbols, that is merged beside others.
SHORT = 64
#: Known words kept by a Python worker, and words merged at once: they bound memory, never the result.
MEMO_WORDS = 400_000
WORDS_AT_ONCE = 4_000
#: Documents whose words are looked up together.
TEXTS_AT_ONCE = 400

_NONE = np.int32(2**31 - 1)

_LOW = "".join(map(chr, range(0x250)))
#: Texts of these characters are split here, all others by the library's own normaliser and splitter.
_PLAIN = re.compile("[\t-\r -ɏ]*")


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in _LOW if unicodedata.category(c)[0] == kind)


#: The vocabulary's splitting rule over the plain characters.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{l}]+|[{n}]|[^{l}{n}{s}]+".format(l=_class("L"), n=_class("N"), s="\t-\r \x85\xa0"))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    other = [b for b in range(256) if b not in set(own)]
    table = {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(other)}
    return [table[b] for b in range(256)]


class Merges:
    """Merge table of a vocabulary: rank and product of an adjacent pair of symbol ids."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.size = max(vocabulary.values()) + 1
        self.inner = np.array([vocabulary[c] for c in byte_symbols()], dtype=np.int64)
        self.final = np.array([vocabulary[c + suffix] for c in byte_symbols()], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], dtype=np.int64)
        self.product = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        _, first = np.unique(key, return_index=True)  # sorted by key; a repeated pair keeps its lowest rank
        self.keys, self.ranks = key[first], first.astype(np.int32)
        self.table = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` where the two do not merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Smallest symbols of all words, one after another, and the number in each word (none is empty)."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids, last = self.inner[raw], np.cumsum(sizes) - 1
        ids[last] = self.final[raw[last]]
        return ids, sizes

    def merge_side_by_side(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges words of at most ``SHORT`` symbols: ids of all words, and their number in each.

        A word has a row of ``width`` slots (one more for its end) and a tree of ``2 * width`` nodes; the arrays are
        flat, a row is known by where it starts."""
        words, width = len(sizes), max(2, 1 << int(sizes.max() - 1).bit_length())
        line, column = width + 1, np.arange(width + 1, dtype=np.int64)
        alive = column < sizes[:, None]
        symbol = np.zeros((words, line), dtype=np.int64)
        symbol[alive] = ids
        rank = np.full((words, width), _NONE, dtype=np.int32)
        pairs = alive[:, 1:]
        rank[pairs] = self.rank(symbol[:, :-1][pairs], symbol[:, 1:][pairs])
        tree = np.empty((words, 2 * width), dtype=np.int32)
        tree[:, width:] = np.where(rank == _NONE, _NONE, rank * SHORT + column[:-1])
        for level in range(width.bit_length() - 2, -1, -1):
            at = 1 << level
            tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
        follows = np.tile(np.arange(1, line + 1, dtype=np.int32), (words, 1)).ravel()  # the next living slot
        before = np.tile(np.arange(-1, width, dtype=np.int32), (words, 1)).ravel()
        alive, symbol, tree = alive.ravel(), symbol.ravel(), tree.ravel()

        rows = np.flatnonzero(tree[1 :: 2 * width] != _NONE)
        while len(rows):
            start, root, size = rows * line, rows * (2 * width), sizes[rows]
            best = tree[root + 1]
            slot, rank = best % SHORT, best // SHORT
            here = start + slot
            gone = follows[here]
            after = follows[start + gone]
            made = self.product[rank]
            symbol[here] = made
            alive[start + gone] = False
            follows[here] = after
            before[start + after] = slot
            left = before[here]
            # Three leaves change: the merged pair's second one is gone, and the new symbol has new neighbours.
            right_rank = np.where(after < size, self.rank(made, symbol[start + after]), _NONE)
            left_rank = np.where(left >= 0, self.rank(symbol[start + left], made), _NONE)
            left = np.where(left >= 0, left, gone)
            node = np.concatenate([gone, slot, left]) + width
            root = np.concatenate([root, root, root])
            value = np.concatenate([np.full(len(rows), _NONE), right_rank * SHORT + slot, left_rank * SHORT + left])
            missing = np.concatenate([np.ones(len(rows), bool), right_rank == _NONE, left_rank == _NONE])
            value[missing] = _NONE
            tree[root + node] = value
            while node[0] > 1:  # all leaves have one depth
                node = node >> 1
                at = root + node
                below = at + node
                tree[at] = np.minimum(tree[below], tree[below + 1])
            rows = rows[tree[rows * (2 * width) + 1] != _NONE]
        return symbol[alive], alive.reshape(words, line).sum(axis=1)

    def merge_alone(self, symbols: list[int]) -> list[int]:
        """Merges one word of any length."""
        n = len(symbols)
        width, size, rank, none = 1 << max(1, (n - 1).bit_length()), self.size, self.table.get, 1 << 62
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = rank(symbols[i] * size + symbols[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        follows, before, product = list(range(1, n + 1)), list(range(-1, n)), self.product.tolist()
        symbols = list(symbols)

        def put(slot: int, other: int) -> None:
            r = rank(symbols[slot] * size + symbols[other]) if other < n else None
            at = width + slot
            tree[at] = none if r is None else r * width + slot
            while at > 1:
                at >>= 1
                lower = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == lower:
                    break
                tree[at] = lower

        while tree[1] != none:
            r, slot = divmod(tree[1], width)
            gone = follows[slot]
            after = follows[gone]
            symbols[slot], symbols[gone] = product[r], -1
            follows[slot] = after
            if after < n:
                before[after] = slot
            put(gone, n)
            put(slot, after)
            if before[slot] >= 0:
                put(before[slot], slot)
        return [s for s in symbols if s >= 0]

    def encode(self, words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Places of some words, the ids of all of them, and their number in each; every word is in one such part."""
        by_width: dict[int, list[int]] = {}
        for place, word in enumerate(words):
            n = len(word)
            by_width.setdefault((n - 1).bit_length() if n <= SHORT else -1, []).append(place)
        for width, places in by_width.items():
            for at in range(0, len(places), WORDS_AT_ONCE):
                some = places[at : at + WORDS_AT_ONCE]
                ids, sizes = self.symbols([words[p] for p in some])
                if width < 0:
                    parts = [self.merge_alone(part.tolist()) for part in np.split(ids, np.cumsum(sizes)[:-1])]
                    yield some, np.array(list(chain.from_iterable(parts))), np.array(list(map(len, parts)))
                else:
                    yield some, *self.merge_side_by_side(ids, sizes)


class TreeEncoder:
    """Whole texts to ids, as strings: of each known word the decimal ids and the tokens, each joined by a space."""

    def __init__(self, path: str) -> None:
        self.library = load_tokenizer(path)
        self.merges = Merges(path)
        names = list(range(self.library.get_vocab_size(with_added_tokens=True)))
        tokens = [self.library.id_to_token(i) or "" for i in names]
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {text: (str(i), tokens[i]) for text, i in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.byte_of = {c: b for b, c in enumerate(byte_symbols())}
        # Each id within a word, then each id as a word's last one.
        self.names = [f"{i} " for i in names] + [f"{i}\n" for i in names]
        self.tokens = [f"{t} " for t in tokens] + [f"{t}\n" for t in tokens]
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings."""
        plain = unicodedata.normalize("NFC", text)
        if _PLAIN.fullmatch(plain):
            lower = plain.lower()
            if _PLAIN.fullmatch(lower):  # some capitals lower to letters beyond
                return _SPLIT.findall(lower)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in pieces]

    def learn(self, words: list[str]) -> None:
        for places, ids, counts in self.merges.encode([w.encode() for w in words]):
            ids = ids.astype(np.int64)
            ids[np.cumsum(counts) - 1] += len(self.names) // 2
            codes, some = ids.tolist(), [words[p] for p in places]
            self.ids.update(zip(some, "".join(map(self.names.__getitem__, codes)).split("\n")))
            self.decoded.update(zip(some, "".join(map(self.tokens.__getitem__, codes)).split("\n")))

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Per text: number of ids, ids in decimal joined by a space, and the decoded text."""
        split: list[list[str]] = []
        for text in texts:
            if any(s in text for s in self.special):
                parts = self.cut.split(text)  # odd places hold the special strings, which no word can equal
                split.append([w for i, part in enumerate(parts) for w in ([part] if i % 2 else self.words(part))])
            else:
                split.append(self.words(text))
        if len(self.ids) > MEMO_WORDS:
            self.ids.clear()
            self.decoded.clear()
        if not self.ids:
            for text, (name, token) in self.special.items():
                self.ids[text], self.decoded[text] = name, token
        new = set(chain.from_iterable(split)).difference(self.ids)
        self.learn(sorted(new))
        out = []
        for words in split:
            ids = " ".join(map(self.ids.__getitem__, words))
            out.append((ids.count(" ") + 1 if words else 0, ids, " ".join(map(self.decoded.__getitem__, words))))
        return out


_ENCODERS: dict[str, TreeEncoder] = {}


def encoder(path: str) -> TreeEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TreeEncoder(path)
    return _ENCODERS[path]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _encode(path: str, with_text: bool):
    def run(batches):
        tree = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                some = batch.slice(at, TEXTS_AT_ONCE)
                found = tree.encode(some.column(1).to_pylist())
                columns = [some.column(0), pa.array([n for n, _, _ in found], pa.int64())]
                columns += [pa.array([_digest(ids) for _, ids, _ in found]), pa.array([_digest(text) for _, _, text in found])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_text:
                    ids = pa.array([list(map(int, ids.split())) for _, ids, _ in found], pa.list_(pa.int32()))
                    columns, names = [*columns, ids, pa.array([text for _, _, text in found])], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def encode_documents(
    docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", with_text: bool = False
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; with ``with_text`` also the
    ids (``ids``) and the decoded text (``decoded``)."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(_encode(tokenizer, with_text), schema + (", ids array<int>, decoded string" if with_text else ""))
