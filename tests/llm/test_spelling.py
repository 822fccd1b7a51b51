"""Spelling variants against brute force: the machine alone, ranges, counts and whole queries."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pipekit.llm import spelling
from pipekit.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, word string, n long, form string, part int"
LETTERS = "".join(map(chr, [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]))


def one_edit(left, right):
    if abs(len(left) - len(right)) > 1 or left == right:
        return False
    at = spelling.shared(left, right)
    return left[at + (len(left) >= len(right)) :] == right[at + (len(right) >= len(left)) :]


def near_brute(words):
    """Every word's edits over the whole alphabet, looked up: ordered pairs."""
    known, out = set(words), set()
    for w in words:
        for i in range(len(w) + 1):
            edits = {w[:i] + w[i + 1 :]} | {w[:i] + c + w[i:] for c in LETTERS} | {w[:i] + c + w[i + 1 :] for c in LETTERS if i < len(w)}
            out.update((w, x) for x in edits & known if x != w)
    return out


def brute(texts):
    counts = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = defaultdict(list)
    for w, x in near_brute(words):
        near[w].append(x)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def some_words(rng, n, letters="abcé", most=9):
    return sorted({"".join(rng.choices(letters, k=rng.randrange(1, most))) for _ in range(n)})


@pytest.mark.parametrize("letters", ["a", "ab", "abcé", "abcdefghijklmnopqrstuvwxyzÀÿ"])
def test_machine_enumerates_every_pair_once(letters):
    rng = random.Random(1)
    for n in (1, 2, 5, 40, 400):
        words = some_words(rng, n, letters)
        left, right = spelling.Acceptor(words).pairs()
        pairs = [frozenset((words[i], words[j])) for i, j in zip(left, right, strict=True)]
        assert len(pairs) == len(set(pairs)) and set(pairs) == {frozenset(p) for p in near_brute(words)}
        assert all(one_edit(*p) for p in pairs)


def test_acceptor_is_minimal_and_ranks_words():
    words = sorted(["taps", "tops", "tap", "top", "cats", "cat"])
    machine = spelling.Acceptor(words)
    assert len(machine.arcs) == 7  # one state per right language
    for place, word in enumerate(words):
        state, rank = machine.root, 0
        for letter in word:
            state, before = machine.arcs[state][letter]
            rank += before
        assert machine.final[state] and rank == place


def test_empty_and_very_long_words():
    assert spelling.Acceptor([]).pairs() == ([], [])
    long = "ab" * 20_000
    words = sorted([long, long + "a", long[:17_000] + "c" + long[17_001:], "b" + long, "abab"])
    left, right = spelling.Acceptor(words).pairs()
    assert {frozenset((words[i], words[j])) for i, j in zip(left, right)} == {
        frozenset((x, y)) for x in words for y in words if one_edit(x, y)
    }


@pytest.mark.parametrize("range_words", [3, 10, 50, 10_000])
def test_ranges_lose_no_pair(spark, range_words):
    """Ranges of a few words each: most pairs lie in two of them."""
    rng = random.Random(2)
    words = some_words(rng, 300, "abc", 8) + ["prefix" + w for w in some_words(rng, 60, "ab", 6)]
    frame = spark.createDataFrame([(w, 1 + len(w)) for w in sorted(set(words))], "word string, n long")
    pairs = [(r.word, r.near) for r in spelling.near_pairs(frame, range_words).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == near_brute(set(words))


def test_cut_points_deal_words_evenly():
    rng = random.Random(3)
    words = ["same" * 5 + w for w in some_words(rng, 4000, "abcdefgh", 9)]
    cuts = spelling.cut_points(rng.sample(words, 400), 10)
    sizes = Counter(spelling.bisect_right(cuts, w) for w in words)
    assert len(sizes) == 10 and max(sizes.values()) < 2 * len(words) / 10


def documents(rng, n):
    stems = ["colour", "color", "theatre", "theater", "größe", "grösse", "naïve", "aaaaa", "aaaaaa", "aaaaaaa", "Analyse", "analyze"]
    stems += some_words(rng, 300, "abcde", 8)
    return [(i, " ".join(rng.choices(stems, k=rng.randrange(1, 200)))) for i in range(n)]


@pytest.mark.parametrize("range_words", [20, 20_000])
def test_groups_against_brute_force(spark, range_words):
    rng = random.Random(4)
    texts = documents(rng, 60) + [(1, None), (2, ""), (None, "colour colour colour 12 COLOUR"), (None, "colours"), (7, "colours colours"), (7, "colours")]
    texts += [(90, "x" * 4000), (91, "x" * 4000), (92, "x" * 4000), (93, "x" * 4001), (93, "x" * 4001), (94, "x" * 4001), (95, "Àéîõü×÷ÿ" * 3)]
    frame = spark.createDataFrame([(i, t, "w", 1, "f", 0) for i, t in texts], SCHEMA)
    groups = spelling.spelling_groups(frame, range_words=range_words)
    assert found(groups) == brute(texts)
    assert groups.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_chains_lead_to_their_root(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbbb": 95, "zzzzz": 4}
    texts = [(200 + i, " ".join([w] * n)) for i, (w, n) in enumerate(counts.items())]
    texts = [(i, t) for i, t in texts if zlib.crc32(f"{i}:{t.split()[0]}".encode()) % 97]
    frame = spark.createDataFrame([(i, t, "w", 1, "f", 0) for i, t in texts], SCHEMA)
    groups = spelling.spelling_groups(frame)
    assert found(groups) == brute(texts) and {r.root for r in groups.collect()} == {"bbbbb", "bbbbbb", "zzzzz"}


def test_empty_table(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    path = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert found(QUERIES["op11_edit_composition"](spark, path)) == brute(texts)
