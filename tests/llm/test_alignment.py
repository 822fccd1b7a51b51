"""Alignment of two tokenizers against brute force; the fragment monoid's laws; odd and very long rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pipekit.llm import alignment
from pipekit.llm.queries import BYTE_BPE, BYTE_RANKS, PIECE_MODEL, QUERIES

SCHEMA = "doc_id long, text string, n_a long, pair string, block string, links binary, seq long"


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)


def brute(libraries, texts):
    """The contract, token by token, with each library's own encoding of whole texts."""
    a, b = libraries
    byte_of = {}
    own = [x for x in range(256) if 0x21 <= x <= 0x7E or 0xA1 <= x <= 0xFF and x != 0xAD]
    for x in range(256):
        byte_of[chr(x) if x in own else chr(0x100 + sum(y not in own for y in range(x)))] = x
    documents, counts = [], Counter()
    for doc_id, text in texts:
        if not text:
            documents.append((doc_id, None))
            continue
        ids_a, ids_b = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            documents.append((doc_id, None))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))).tolist(), np.cumsum(list(map(len, bytes_b))).tolist()
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            links.append((ids_a[k - 1], ids_b[m - 1]))
            i, j = k, m
        counts.update(links)
        documents.append((doc_id, (len(ids_a), len(ids_b), groups, links)))
    highest = Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for doc_id, found in documents:
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = found
        best = sum(counts[x] == highest[x[1]] for x in links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def random_text(rng, n):
    words = ["the", "tokens", "naïve", "größe", "日本語テキスト", "x1", "...", "👍🏽", "\n", "", " ", "<|endoftext|>", "<s>", "don't", "\t", "é"]
    return rng.choice([" ", " ", "  ", ""]).join(rng.choices(words, k=n))


def test_pieces_between_cuts_encode_as_the_whole(libraries):
    """Why a text may be cut there: on random texts the pieces' tokens are the whole text's."""
    rng, pair = random.Random(1), alignment.TwoTokenizers(BYTE_RANKS, PIECE_MODEL)
    texts = [random_text(rng, rng.randrange(1, 40)) for _ in range(600)]
    texts += ["".join(rng.choices("ab \n\t\x1c\x85\xa0 　▁é日'.5", k=30)) for _ in range(1500)]
    for text in texts:
        tokens = pair.tokens(text)
        if tokens is not None:
            assert tokens[0].tolist() == libraries[0].encode(f" {text}", add_special_tokens=False).ids, repr(text)
            assert tokens[1].tolist() == libraries[1].encode(text), repr(text)
        elif text:
            assert "▁" in text or "".join(libraries[1].decode(libraries[1].encode(text))) != text


def test_no_entry_goes_on_over_a_space(libraries):
    pieces = [libraries[1].id_to_piece(i) for i in range(libraries[1].get_piece_size())]
    assert not [p for p in pieces if "▁" in p.lstrip("▁")]


def test_fragments_are_a_monoid():
    rng = random.Random(2)
    for _ in range(300):
        length = rng.randrange(1, 60)
        inner = range(1, length)
        ends_a = np.array(sorted({length, *rng.sample(inner, rng.randrange(length))}))
        ends_b = np.array(sorted({length, *rng.sample(inner, rng.randrange(length))}))
        a, b = np.arange(len(ends_a), dtype=np.int32), np.arange(len(ends_b), dtype=np.int32)
        whole = alignment.fragments_at(a, b, ends_a, ends_b, [0, length])[0]
        cuts = [0, *sorted(rng.sample(inner, rng.randrange(length))), length]
        parts = alignment.fragments_at(a, b, ends_a, ends_b, cuts)
        left = alignment.EMPTY
        for part in parts:
            left = left + part
        right = alignment.EMPTY
        for part in reversed(parts):
            right = part + right
        for made in (left, right, alignment.compose(parts)):
            for x, y in zip(vars(made).values(), vars(whole).values(), strict=True):
                assert np.array_equal(x, y)


def test_documents_against_brute_force(spark, libraries):
    rng = random.Random(3)
    texts = [(1, None), (2, ""), (3, " "), (None, "a ▁ b"), (None, "one two"), (4, "one two"), (4, "one two"), (5, "\x00 \x1f x")]
    texts += [(10 + i, random_text(rng, rng.randrange(1, 60))) for i in range(60)]
    frame = spark.createDataFrame([(i, t, 1, "p", "b", b"", 0) for i, t in texts], SCHEMA)
    aligned = alignment.align_documents(frame, BYTE_RANKS, PIECE_MODEL)
    assert found(aligned) == brute(libraries, texts)
    assert alignment.align_documents(frame.limit(0), BYTE_RANKS, PIECE_MODEL).collect() == []


def test_long_documents_are_composed_over_tasks(spark, libraries, monkeypatch):
    """Chunks and ranges far smaller than the texts, some of which hold no place to cut at."""
    monkeypatch.setattr(alignment, "RANGE_BYTES", 37)
    rng = random.Random(4)
    texts = [(i, random_text(rng, 400)) for i in range(6)] + [(7, "x" * 3000), (8, "日本" * 700), (9, "one two " * 300), (9, "one two " * 300)]
    texts += [(11, "short one"), (12, "a ▁ b " * 200)]
    frame = spark.createDataFrame([(i, t, 1, "p", "b", b"", 0) for i, t in texts], SCHEMA)
    aligned = alignment.align_documents(frame, BYTE_RANKS, PIECE_MODEL, long_bytes=200)
    assert found(aligned) == brute(libraries, texts)
    whole = alignment.long_fragments(frame.select("doc_id", "text"), BYTE_RANKS, PIECE_MODEL, 200)
    assert whole.count() == len(texts)  # one fragment is left of each


def test_ranges_cut_groups(libraries):
    """At the real sizes a cut does fall into a group, so that open ends are composed."""
    pair = alignment.TwoTokenizers(BYTE_RANKS, PIECE_MODEL)
    text = "incomprehensibility " * 6000
    parts = pair.ranges(text, 0)
    assert len(parts) > 5 and any(p.sizes_a[-1] or p.sizes_b[-1] for p in parts[:-1])
    (composed,), (whole,) = pair.rendered([alignment.compose(parts)]), pair.rendered([pair.fragment(text)])
    assert composed == whole == pair.align([text])[0]


def test_a_full_memory_changes_nothing(monkeypatch):
    rng, pair = random.Random(6), alignment.TwoTokenizers(BYTE_RANKS, PIECE_MODEL)
    texts = [random_text(rng, 50) for _ in range(40)] + ["x" * 500, ""]
    expected = pair.align(texts)
    monkeypatch.setattr(alignment, "MEMO_PIECES", 1)
    monkeypatch.setattr(alignment, "PIECES_AT_ONCE", 3)
    assert [pair.align([t])[0] for t in texts] == expected
    assert all(len(p) <= alignment.MEMO_LENGTH for p in pair.known)


def test_query(spark, libraries):
    path = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert found(QUERIES["op13_fragment_alignment"](spark, path)) == brute(libraries, texts)


def test_a_worker_keeps_no_pieces_after_its_task():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["one two three", "two three four"], "size": [13, 14]})
    (block,) = alignment._blocks(BYTE_RANKS, PIECE_MODEL)([batch])
    pair = alignment.two_tokenizers(BYTE_RANKS, PIECE_MODEL)
    assert block.column(1).to_pylist() == [[1, 2]] and not pair.known and not pair.before


def test_a_task_runs_one_python_function(spark, monkeypatch):
    """Functions of one task run in workers side by side; each keeps its tokenizers while the executor lives."""
    from conftest import plan_text

    plans, write = {}, alignment.stage_table
    monkeypatch.setattr(alignment, "stage_table", lambda df, tag: (plans.setdefault(tag, plan_text(df)), write(df, tag))[1])
    texts = [(1, "short one"), (2, "one two " * 300), (3, "x" * 3000)]
    frame = spark.createDataFrame([(i, t, 1, "p", "b", b"", 0) for i, t in texts], SCHEMA)
    assert alignment.align_documents(frame, BYTE_RANKS, PIECE_MODEL, long_bytes=200).count() == 3
    above: list[tuple[int, str]] = []  # place and name of the nodes that a line of the tree stands under
    chained = []
    for place, node in re.findall(r"^([\s:+*|-]*)(\w+)", plans["blocks"].split("\n\n")[0], re.M):
        above = [x for x in above if x[0] < len(place)] + [(len(place), node)]
        task = [name for _, name in above]
        task = task[max((i for i, name in enumerate(task) if "Exchange" in name), default=0) :]
        chained.append(sum("Arrow" in name for name in task))
    assert max(chained) == 1 and sum("Arrow" in line for line in plans["blocks"].split("\n\n")[0].split("\n")) >= 3


@pytest.mark.parametrize("n_pairs, width", [(1 << 16, 2), ((1 << 16) + 1, 4)])
def test_links_take_as_many_bytes_as_their_ranks_need(n_pairs, width):
    links = np.random.default_rng(7).permutation(np.arange(n_pairs, dtype="<u4") * 5)
    block = alignment._Block()
    block.add(1, alignment.Aligned(9, 9, n_pairs, "x", links.tobytes()), 1)
    block.add(2, None, 1)
    block.add(3, alignment.Aligned(9, 9, 3, "x", links[:3].tobytes()), 1)
    row = block.batch()
    assert len(row.column(6)[0].as_py()) == width * (n_pairs + 3)
    left = pa.Table.from_batches([row]).append_column("n_pairs", pa.array([n_pairs]))
    pairs = row.column(7)[0].values
    n, best = np.arange(n_pairs), np.arange(n_pairs) % 2 == 0
    right = pa.table({"pair": pairs, "n": n, "best": best})
    got = alignment._count_back(None, left, right).to_pylist()
    first = np.searchsorted(pairs.to_numpy(), links[:3])
    assert [(r["n_links"], r["n_best"], r["count_sum"]) for r in got] == [
        (n_pairs, best.sum(), n.sum()), (0, 0, 0), (3, best[first].sum(), n[first].sum())
    ]
