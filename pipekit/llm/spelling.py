"""Spelling variants by composing the vocabulary's minimised acceptor, a one-edit transducer and the acceptor again.

Reading both words of a pair side by side, the composed machine is in a state (p, no edit yet, p) as long as they agree
- an acceptor without branches on equal letters has one state for an equal prefix - and in (p', one edit, q') after the
edit, from where both must end alike.  ``Acceptor.pairs`` enumerates what it accepts: for every state the edits that can
be made there (a replaced letter leaves it by two arcs, a deleted one by one arc on one side only) and, for the two
states reached, the endings that both accept.  Equal endings share states, so endings of two states are met once.

The vocabulary is dealt by ranges of the sorted words, cut at a sample, so that every task has about ``RANGE_WORDS`` words
whatever prefixes they share, and its own minimised acceptor.  A pair of two ranges can agree only up to a prefix that
some cut has too (all words between the two have it, and so has the cut).  Those few initial states (p, p) above the
ranges are dealt by what the machine must still accept: each word states, for each of these prefixes, its ending after
the edit, and words of one prefix and one ending meet; they differ in one letter, so at most an alphabet of them.

Text: NULL has no words.  A NULL ``doc_id`` counts as the empty text in a run's checksum.  Repeated rows each count,
other columns are ignored, an empty table gives an empty one.  Ties between forms go to the smallest word.
"""

from __future__ import annotations

import re
import sys
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipekit.llm.common import stage_table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

MIN_LENGTH = 5
MIN_COUNT = 3
DELETE_ONE_IN = 97
#: A form occurs at least so many times as often as its variant.
FORM_RATIO = 2
#: Words of a task's acceptor, on average, and words of the sample per range that the ranges are cut by.
RANGE_WORDS = 20_000
SAMPLE_PER_RANGE = 16
#: Distinct words a task counts before it sends them on; bounds its memory, never the result.
COUNTED_WORDS = 400_000
TEXTS_AT_ONCE = 200


# ---------------------------------------------------------------- words


def damaged(doc_id: int | None, run: str) -> str:
    """A lower-cased run, without one of its letters if its checksum says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % DELETE_ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _count(batches) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def send() -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
            some = batch.slice(at, TEXTS_AT_ONCE)
            for doc_id, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                if text is None:
                    continue
                prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in Counter(RUN.findall(text)).items():
                    run = run.lower() if run.isascii() else run.translate(LOWER)
                    # The checksum of id and run goes on from that of the id.
                    word = run if zlib.crc32(run.encode(), prefix) % DELETE_ONE_IN else damaged(doc_id, run)
                    if len(word) >= MIN_LENGTH:
                        counts[word] += n
            if len(counts) >= COUNTED_WORDS:
                yield send()
    yield send()


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: words of at least ``MIN_LENGTH`` letters and ``MIN_COUNT`` occurrences."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counted = rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= MIN_COUNT)


# ---------------------------------------------------------------- the machine


def shared(left: str, right: str) -> int:
    """Letters that both words start with."""
    n = 0
    for a, b in zip(left, right):
        if a != b:
            break
        n += 1
    return n


class Acceptor:
    """Minimal acyclic acceptor of sorted distinct words; a word's rank is its place among them.

    States are numbered so that arcs lead to smaller numbers.  An arc has the number of words before it that its
    state accepts, so that the ranks of a pair are sums along its two paths."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self.depth = 0
        known: dict[tuple, int] = {}
        path_arcs: list[list] = [[]]  # of the states on the last word's path, from the root
        path_final = [False]

        def close() -> int:
            arcs, final = path_arcs.pop(), path_final.pop()
            key = (final, *arcs)
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.arcs)
                at, table = int(final), {}
                for letter, to in zip(arcs[::2], arcs[1::2]):
                    table[letter] = (to, at)
                    at += self.size[to]
                self.arcs.append(table)
                self.final.append(final)
                self.size.append(at)
            return state

        before = ""
        for word in words:
            same = shared(before, word)
            for depth in range(len(before), same, -1):
                state = close()
                path_arcs[-1] += (before[depth - 1], state)
            for _ in range(same, len(word)):
                path_arcs.append([])
                path_final.append(False)
            path_final[-1] = True
            self.depth = max(self.depth, len(word))
            before = word
        for depth in range(len(before), 0, -1):
            state = close()
            path_arcs[-1] += (before[depth - 1], state)
        self.root = close()

    def pairs(self) -> tuple[list[int], list[int]]:
        """Ranks of all pairs of words at one edit, each pair once."""
        arcs, final, size = self.arcs, self.final, self.size
        met: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if sys.getrecursionlimit() < self.depth + 1000:
            sys.setrecursionlimit(self.depth + 1000)

        def meet(p: int, q: int) -> list[tuple[int, int]]:
            """Endings that both states accept, as their ranks in either."""
            if p == q:
                return [(i, i) for i in range(size[p])]
            found = met.get((p, q))
            if found is None:
                a, b = arcs[p], arcs[q]
                found = [(0, 0)] if final[p] and final[q] else []
                for letter in a.keys() & b.keys():
                    (x, before_x), (y, before_y) = a[letter], b[letter]
                    found += [(before_x + i, before_y + j) for i, j in meet(x, y)]
                met[p, q] = found
            return found

        edits: list[list[tuple[int, int]]] = []  # per state: pairs whose edit is made there
        holds: list[bool] = []  # whether the state or one after it has such pairs
        for p, table in enumerate(arcs):
            here: list[tuple[int, int]] = []
            out = list(table.items())
            for k, (letter, (x, before_x)) in enumerate(out):
                for _, (y, before_y) in out[k + 1 :]:  # replaced
                    here += [(before_x + i, before_y + j) for i, j in meet(x, y)]
                # Deleted.  Of a run of equal letters the last one: an ending that starts with the letter is left to
                # the states after.
                if final[x] and final[p]:
                    here.append((before_x, 0))
                for after, (y, before_y) in arcs[x].items():
                    if after != letter and after in table:
                        z, before_z = table[after]
                        here += [(before_x + before_y + i, before_z + j) for i, j in meet(y, z)]
            edits.append(here)
            holds.append(bool(here) or any(holds[x] for x, _ in table.values()))

        left: list[int] = []
        right: list[int] = []
        todo = [(self.root, 0)]
        while todo:
            p, at = todo.pop()
            for i, j in edits[p]:
                left.append(at + i)
                right.append(at + j)
            todo += [(x, at + before) for x, before in arcs[p].values() if holds[x]]
        return left, right


# ---------------------------------------------------------------- ranges


def cut_points(sample: list[str], ranges: int) -> list[str]:
    """First letters, as few as tell them apart, of the words that start the second and later ranges."""
    sample = sorted(set(sample))
    places = sorted({len(sample) * i // ranges for i in range(1, ranges)} - {0})
    return [sample[i][: shared(sample[i - 1], sample[i]) + 1] for i in places]


def _assign(cuts: list[str]):
    """Adds each word's range and the length of the longest prefix that it shares with a cut."""
    edges = ["", *cuts, ""]

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            part = [bisect_right(cuts, w) for w in words]
            deep = [max(shared(edges[k], w), shared(edges[k + 1], w)) for k, w in zip(part, words)]
            columns = [*batch.columns, pa.array(part, pa.int32()), pa.array(deep, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "part", "deep"])

    return run


def _pairs_of_range(pdf: pd.DataFrame) -> pd.DataFrame:
    words, n = pdf["word"].to_numpy(), pdf["n"].to_numpy()
    # Code points and UTF-8 bytes sort alike, and so do Python's strings.
    order = sorted(range(len(words)), key=words.__getitem__)
    words, n = words[order], n[order]
    left, right = (np.array(x, dtype=np.int64) for x in Acceptor(words.tolist()).pairs())
    one, two = np.concatenate([left, right]), np.concatenate([right, left])
    return pd.DataFrame({"word": words[one], "near": words[two], "near_n": n[two]})


_PAIR = "word string, near string, near_n long"


def near_pairs(words: DataFrame, range_words: int = RANGE_WORDS) -> DataFrame:
    """``word, near, near_n`` for every ordered pair of words (``word, n``, distinct) at one edit."""
    spark = words.sparkSession
    total = words.count()
    ranges = max(1, -(-total // range_words))
    cuts: list[str] = []
    if ranges > 1:
        share = max(1, total // (ranges * SAMPLE_PER_RANGE))
        sample = words.filter(F.pmod(F.xxhash64("word"), F.lit(share)) == 0).select("word")
        cuts = cut_points([r.word for r in sample.collect()], ranges)
    dealt = stage_table(words.select("word", "n").mapInArrow(_assign(cuts), "word string, n long, part int, deep int"), "ranges")
    # As many tasks as ranges: their words are few bytes, but work.
    inside = dealt.repartition(ranges, "part").groupBy("part").applyInPandas(_pairs_of_range, _PAIR)
    if not cuts:
        return inside
    # Pairs of two ranges: for each prefix shared with a cut, the ending after an edit.  ``gone`` is the letter left out
    # of the word, or empty where the other word has one more; of a run of equal letters the last one goes.
    place = dealt.withColumn("at", F.explode(F.sequence(F.lit(0), "deep")))
    shorter = place.selectExpr(
        "word", "n", "part", "left(word, at) || '|' || substring(word, at + 2) AS key", "substring(word, at + 1, 1) AS gone",
        "substring(word, at + 1, 1) <> substring(word, at + 2, 1) AS last",
    ).filter("gone <> ''")
    whole = place.selectExpr("word", "n", "part", "left(word, at) || '|' || substring(word, at + 1) AS key", "'' AS gone", "true AS last")
    members = F.collect_list(F.struct("word", "n", "part", "gone", "last")).alias("members")
    meeting = shorter.unionByName(whole).groupBy("key").agg(members, F.min("part").alias("low"), F.max("part").alias("high"))
    sides = meeting.filter("low < high").select(F.explode("members").alias("x"), "members").select("x", F.explode("members").alias("y"))
    replaced, deleted = "x.gone <> '' AND y.gone <> ''", "x.gone <> y.gone AND x.last AND y.last"
    between = sides.filter(f"x.part <> y.part AND ({replaced} OR {deleted})").selectExpr("x.word", "y.word AS near", "y.n AS near_n")
    return inside.unionByName(between)


# ---------------------------------------------------------------- forms


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form, by pointer doubling.  A form occurs at least twice as often as its word, so
    chains are short: their length is at most the logarithm of the largest count, the rounds the logarithm of that."""
    step = stage_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        joined = step.join(ahead, "root", "left")
        step = stage_table(joined.select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        step = step.select("word", "root")


def spelling_groups(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", range_words: int = RANGE_WORDS
) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``."""
    words = stage_table(vocabulary(docs, doc_id, text), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("form"))).alias("best")
    found = near_pairs(words, range_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = words.join(found, "word", "left")
    follows = -F.col("best.minus_n") >= FORM_RATIO * F.col("n")
    forms = joined.select(
        "word",
        F.when(follows, F.col("best.form")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(follows, -F.col("best.minus_n")).alias("form_n"),
    )
    forms = stage_table(forms, "forms")
    ends = roots(forms.filter("form IS NOT NULL"))
    named = forms.join(ends, "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
