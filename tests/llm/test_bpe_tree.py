"""Segment-tree BPE against the library, code point by code point, and on odd rows."""

import hashlib
import random

import pytest

from pipekit.llm import bpe_tree
from pipekit.llm.queries import QUERIES, WORD_BPE
from pipekit.llm.token_cache import load_tokenizer

SCHEMA = "doc_id long, text string, n_tokens long, ids string, text2 string"


@pytest.fixture(scope="module")
def tree():
    return bpe_tree.TreeEncoder(WORD_BPE)


def check(tree, texts):
    library = load_tokenizer(WORD_BPE)
    for text, (n, ids, decoded) in zip(texts, tree.encode(texts), strict=True):
        expected = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(expected), " ".join(map(str, expected))), repr(text[:100])
        assert decoded == library.decode(expected, skip_special_tokens=False)


def test_every_code_point(tree):
    """Alone, doubled, between letters and between digits."""
    points = [c for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    check(tree, [f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 {chr(c)}" for c in points])


def test_capitals_that_leave_the_plain_characters(tree):
    check(tree, ["ƏLAVƏ MƏLUMAT", "ƁANGARE", "ƐWE ƆKRA", "İΣΑΣ ΟΔΟΣ", "KELVIN K"])


def test_special_strings_and_contractions(tree):
    check(tree, ["<|endoftext|>", "x<|startoftext|>Y<|endoftext|> z<|end", "<|endoftext|><|endoftext|>", "'s 't I'LL don't 'RE"])


def test_word_lengths_around_the_bounds(tree):
    rng = random.Random(4)
    for n in [1, 2, 3, 4, 5, 8, 9, 16, 17, 32, 33, 63, 64, 65, 66, 127, 128, 129, 1000]:
        check(tree, ["a" * n, "".join(rng.choices("abethin", k=n)), "é" * n, "日" * n])


def test_random_words_and_ties(tree):
    rng = random.Random(5)
    check(tree, ["".join(rng.choice("aaabb c'sétn1 ") for _ in range(rng.randrange(200))) for _ in range(1500)])


def test_a_long_word_takes_n_log_n(tree):
    word = "the" * 60_000
    n, ids, _ = tree.encode([word])[0]
    assert n == 60_000 == ids.count(" ") + 1


def test_both_mergers_agree(tree):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdethino", k=rng.randrange(1, 65))).encode() for _ in range(500)]
    for places, ids, counts in tree.merges.encode(words):
        alone = [tree.merges.merge_alone(tree.merges.symbols([words[p]])[0].tolist()) for p in places]
        assert [i for part in alone for i in part] == ids.tolist() and [len(part) for part in alone] == counts.tolist()


def test_a_full_memory_changes_nothing(tree, monkeypatch):
    texts = ["one two three", "two three four", "one five <|endoftext|>"]
    before = tree.encode(texts)
    monkeypatch.setattr(bpe_tree, "MEMO_WORDS", 1)
    assert [tree.encode([t])[0] for t in texts] == before


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (None, "one two"), (4, "one two"), (4, "one two"), (5, "x " * 30_000)]
    docs = spark.createDataFrame([(i, t, 0, "n", "t") for i, t in rows], SCHEMA)
    found = {(r.doc_id, r.n_tokens): r for r in bpe_tree.encode_documents(docs, WORD_BPE, with_text=True).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    for i in (1, 2, 3):
        assert found[i, 0].ids_sha256 == found[i, 0].decoded_sha256 == nothing and found[i, 0].ids == []
    assert found[None, 2].ids_sha256 == found[4, 2].ids_sha256 and found[5, 30_000].decoded.count(" ") == 29_999
    assert bpe_tree.encode_documents(docs, WORD_BPE).count() == len(rows)
    assert bpe_tree.encode_documents(docs.limit(0), WORD_BPE).collect() == []


def test_query(spark):
    library = load_tokenizer(WORD_BPE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op12_bpe_tree"](spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        assert [r.n_tokens, r.ids_sha256, r.decoded_sha256] == [len(ids), *expected]
