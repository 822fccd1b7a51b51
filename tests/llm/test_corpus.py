"""The corpus operators against brute force, and on empty, NULL, repeated and clashing rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest


import corpus_pipeline
from pipekit.llm import (
    common,
    html_text,
    katz,
    language_id,
    line_frequency,
    mixing,
    near_duplicates,
    packing,
    piecewise_hash,
    repeats,
    token_cache,
)
from pipekit.llm.queries import BYTE_BPE, BYTE_RANKS, QUERIES, WORD_BPE

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, line string, key string, node long"
WORDS = [f"w{i}" for i in range(400)]


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, 1, "x", "k", 7) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """NULL ids, texts and sources, empty and long texts, repeated rows, clashing column names."""
    rng = random.Random(5)
    long = " ".join(rng.choices(WORDS, k=20_000))
    some = " ".join(rng.choices(WORDS, k=300))
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (5, long, "b"), (6, some, None), (6, some, None)]
    rows += [(7, some + " more", "c"), (None, some[: len(some) // 2], "c"), (8, "a" * 900, "a"), (9, "é" * 300 + "<|endoftext|> İΣ x y", "a")]
    rows += [(100 + i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 300))), rng.choice("abc")) for i in range(40)]
    return make(spark, rows).cache()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def test_base_measures():
    n, chars, symbols, duplicates, repeated, lines, sizes = line_frequency.measure("a b c\na b c\n\n\nx #| y")
    assert (n, chars, symbols, duplicates, repeated) == (8, 11, 2, 1, 6)
    assert sizes == [3, 3, 2] and lines[0] == lines[1]
    rng = random.Random(1)
    for _ in range(50):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 30))]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
        assert line_frequency.repeated_words(words) == len(covered)


def test_frequent_lines(spark, odd):
    letters = "abcdefghijklmnopqrstuvwxyz"  # digits are alike after normalising
    body = [" ".join(letters[i % 26] * (1 + i // 26) + letters[j % 26] * (1 + j // 26) for j in range(60)) for i in range(30)]
    rows = [(i, f"{body[i]}\nShared line {i % 10}", "h") for i in range(30)] + [(50, "Shared line 1\n" * 40, "h")]
    got = {r.doc_id: r for r in line_frequency.line_frequency(make(spark, rows), min_documents=5).collect()}
    assert all(got[i].n_removed_words == 3 and got[i].kept for i in range(30))
    assert not got[50].kept
    assert line_frequency.line_frequency(odd).count() == odd.count()
    assert line_frequency.line_frequency(odd.limit(0)).count() == 0


def test_token_counts_and_cache(spark, odd, tmp_path):
    cache = str(tmp_path / "cache")
    tokenizer = token_cache.load_tokenizer(BYTE_BPE)
    for _ in range(2):  # the second run finds every digest stored
        got = token_cache.cached_token_counts(odd, BYTE_BPE, ranks=BYTE_RANKS, cache=cache).collect()
        want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
        assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    distinct = len({r.text or "" for r in odd.collect()})
    assert spark.read.parquet(cache).count() == distinct
    assert token_cache.cached_token_counts(odd.limit(0), BYTE_BPE, cache=cache).count() == 0


def brute_repeats(texts, width):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + width] for b in data for p in range(len(b) - width + 1))
    out = []
    for b in data:
        covered = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if count[b[p : p + width]] > 1:
                covered[p : p + width] = b"\1" * width
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((len(b), sum(covered), len([s for s in bytes(covered).split(b"\0") if s]), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats_equal_brute_force(spark, documents, monkeypatch):
    texts = [r.text for r in documents.limit(60).collect()]
    rng = random.Random(3)
    for _ in range(30):
        t, u = rng.choice(texts), rng.choice(texts)
        i, j = rng.randrange(max(1, len(t) - 300)), rng.randrange(len(u))
        texts.append(u[:j] + t[i : i + rng.randrange(150, 400)] + u[j:])
    texts += ["a" * 1000, "abc" * 150, "x" * 199, "y" * 200, "y" * 200, None, "", "é" * 300]
    df = make(spark, list(zip(range(len(texts)), texts, "a" * len(texts))))
    monkeypatch.setattr(repeats, "STEP", 500)  # long texts go by steps
    got = repeats.remove_repeats(df).collect()
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(texts, 200)
    assert repeats.remove_repeats(df.limit(0)).count() == 0


def brute_katz(docs):
    tokens = [(zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, ["<s>", *(t or "").encode().lower().split(), None]) for i, t in docs]
    word, pair = Counter(), Counter()
    for held, w in tokens:
        if not held:
            word.update(w[1:])
            pair.update(zip(w, w[1:]))
    n, v, k = sum(word.values()), len(word), katz.K
    of = lambda c: katz.discounts([sum(x == r for x in c.values()) for r in range(1, k + 2)])
    dp, dw = of(pair), of(word)
    take = lambda c, d: c * d[c - 1] if c <= k else c - katz.TAIL
    unknown = 1 - sum(take(c, dw) for c in word.values()) / n
    p = lambda w: take(word[w], dw) / n if w in word else unknown
    after = {}
    for (a, b), c in pair.items():
        after.setdefault(a, []).append((b, c))
    total = {a: sum(c for _, c in x) for a, x in after.items()}
    alpha = {a: (1 - sum(take(c, dp) for _, c in x) / total[a]) / (1 - sum(p(b) for b, _ in x)) for a, x in after.items()}
    for a in list(after)[:20]:  # each history's probabilities add up to one
        seen = {b for b, _ in after[a]}
        rest = sum(p(w) for w in word if w not in seen) + unknown
        assert math.isclose(sum(take(c, dp) for _, c in after[a]) / total[a] + alpha[a] * rest, 1)
    out = []
    for held, w in tokens:
        score = base = 0.0
        for a, b in zip(w, w[1:]):
            base += math.log10((word[b] + 1) / (n + v + 1))
            q = take(pair[a, b], dp) / total[a] if pair[a, b] else alpha.get(a, 1) * p(b)
            score += math.log10(q)
        out.append((held, len(w) - 1, sum(x in word for x in w[1:]), n, round(base, 4), round(score, 4)))
    return Counter(out)


def test_katz_equals_brute_force(odd, documents, monkeypatch):
    monkeypatch.setattr(katz, "SLICE_BYTES", 20_000)
    for df in (odd, documents):
        model = katz.katz_scores(df, pairs=True)
        got = Counter(
            (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in model.scores.collect()
        )
        want = brute_katz([(r.doc_id, r.text) for r in df.collect()])
        assert sum((got - want).values()) <= 2  # rounding of the fourth digit
        assert model.pairs.count() > 0
    assert katz.katz_scores(odd.limit(0)).scores.count() == 0


def test_bag_minhash_is_unbiased():
    rng, errors = np.random.default_rng(0), []
    for _ in range(30):
        e = np.sort(rng.choice(2**62, 200, replace=False).astype(np.uint64))
        c1 = rng.integers(0, 6, 200)
        c2 = np.where(rng.random(200) < 0.7, c1, rng.integers(0, 6, 200))
        a, b = (e[c1 > 0], c1[c1 > 0]), (e[c2 > 0], c2[c2 > 0])
        same = np.mean(near_duplicates.signature(*a, 1024) == near_duplicates.signature(*b, 1024))
        errors.append(same - near_duplicates.overlap(*a, *b))
    assert abs(np.mean(errors)) < 0.01


def test_overlap_bound_loses_no_pair():
    rng, texts = random.Random(5), [None, "", "same " * 3000]  # the last has over 255 shingles in one bin
    for _ in range(40):
        t = rng.choices(WORDS, k=rng.choice([3, 60, 400]))
        other = [w if rng.random() < 0.97 else rng.choice(WORDS) for w in t]
        texts += [" ".join(t), " ".join(other)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["node", "text"])
    (bags,) = near_duplicates._bags([batch])
    elements, counts, bins = (bags.column(i).to_pylist() for i in (1, 2, 3))
    assert bins[2] is None
    n = len(texts)
    hubs = [i % 3 > 0 for i in range(n)]  # in the second tile only some are hubs
    rows = []
    for tile, is_hub in ((1, [True] * n), (2, hubs)):
        rows += [(tile, 0, 0, i, i, is_hub[i], False, bins[i], elements[i], counts[i]) for i in range(n)]
        rows += [(tile, 0, 0, i, i, True, True, bins[i], elements[i], counts[i]) for i in range(n) if is_hub[i]]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    kinds += [pa.list_(pa.int64()), pa.list_(pa.int32())]
    asked = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list("abcdefghij"))
    pieces = [asked.slice(at, 37) for at in range(0, len(rows), 37)]  # tiles go over batches
    first, second = near_duplicates._links_of_tiles(0.8)(iter(pieces))
    found = [near_duplicates.shingles(t) for t in texts]
    some = [i for i in range(n) if len(found[i][0])]
    alike = {(i, j) for i in some for j in some if i > j and near_duplicates.overlap(*found[i], *found[j]) >= 0.8}
    for links, wanted in ((first, alike), (second, {(i, j) for i, j in alike if hubs[i] or hubs[j]})):
        kept = [(b, a) for a, b in zip(*(c.to_pylist() for c in links.columns))]
        assert kept and set(kept) <= wanted and parts_of(n, kept) == parts_of(n, wanted)
        assert len(kept) == n - len(set(parts_of(n, kept)))  # no link joins what is joined already
    assert not list(near_duplicates._links_of_tiles(0.8)([asked.slice(0, 0)]))
    same = pa.RecordBatch.from_arrays([*asked.columns[:4], pa.array([7] * len(rows)), *asked.columns[5:]], names=list("abcdefghij"))
    assert not list(near_duplicates._links_of_tiles(0.8)([same]))  # one component: nothing left to test


def parts_of(n, pairs):
    """The smallest member of each one's component."""
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_links_of_copies_stay_linear():
    """A tile of many near copies gives one link per member, although nearly every pair is alike."""
    rng, n = random.Random(8), 300
    base = rng.choices(WORDS, k=400)
    texts = [" ".join(base[:i] + ["other"] + base[i + 1 :]) for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts)], names=["node", "text"])
    (bags,) = near_duplicates._bags([batch])
    own = [bags.column(3), bags.column(1), bags.column(2)]
    one, names = pa.array([1] * n), list("abcdefghij")
    yes, no = pa.array([True] * n), pa.array([False] * n)
    sides = [pa.RecordBatch.from_arrays([one, one, one, bags.column(0), bags.column(0), yes, side, *own], names=names) for side in (no, yes)]
    (links,) = near_duplicates._links_of_tiles(0.8)(iter(sides))
    assert links.num_rows == n - 1


def brute_classes(rows):
    bags = [near_duplicates.shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(bags[i][0]) and len(bags[j][0]) and near_duplicates.overlap(*bags[i], *bags[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


@pytest.mark.parametrize("growth, tile", [(near_duplicates.GROWTH, near_duplicates.TILE), (3, 5)])
def test_near_duplicates_equal_brute_force(spark, odd, monkeypatch, growth, tile):
    monkeypatch.setattr(near_duplicates, "GROWTH", growth)
    monkeypatch.setattr(near_duplicates, "TILE", tile)
    rng = random.Random(2)
    base = [rng.choices(WORDS, k=200) for _ in range(6)]
    rows = []
    for i in range(120):  # chains of edits, so that classes are wider than single links
        t = list(base[i % 6])
        for _ in range(i // 12):
            t[rng.randrange(200)] = rng.choice(WORDS)
        rows.append((i, " ".join(t), "a"))
    want = brute_classes([(i, t) for i, t, _ in rows])
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(make(spark, rows)).collect()}
    assert [got[i].class_id for i in range(120)] == want
    assert sum(r.kept for r in got.values()) == len(set(want))
    kept = near_duplicates.without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id in (6, 7)").count() == 1
    assert near_duplicates.without_near_duplicates(odd.limit(0)).count() == 0


def test_mix_meets_its_targets(spark, odd, documents):
    for df in (odd, documents):
        mix = mixing.mix_sources(df)
        taken = mixing.taken_words(mix).collect()
        assert len(taken) == df.count()
        assert all(r.taken <= 2 * r["size"] for r in taken)
        assert Counter(mixing.taken_words(mixing.mix_sources(df)).collect()) == Counter(taken)
        for s in mix.sources.collect():
            got = mix.ranges.join(mix.documents.filter(mix.documents._source.eqNullSafe(s.source)), "_row")
            words = got.selectExpr("sum((high - low) * uses)").first()[0] or 0
            assert abs(words - s.target) <= 2 * mixing.BLOCK_WORDS and s.target <= 2 * s.source_size
    assert mixing.taken_words(mixing.mix_sources(odd.limit(0))).count() == 0


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(n))


def test_main_text(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    chain = html_text.fit(pages, training_pages=20)
    got = {r.page_id: r.text for r in html_text.extract(pages, chain).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        inside = re.sub(r"<[^>]*>", "", re.sub("<br>", " ", re.sub(r"</?(h1|p)>", "\0", inside)))
        lines = [" ".join(html_text.html.unescape(x).split()) for x in inside.split("\0")]
        assert got[r.page_id] == "\n".join(x for x in lines if x)
    other = (
        '<body><div class="menu"><a href=x>Home</a></div><div class="post"><h2>T &amp; U</h2><p>Alpha  beta. Gamma delta.</p>'
        '<div class="comments"><p>I liked it.</p></div></div><div class="sidebar"><ul><li><a href=x>One</a></ul></div>'
    )
    assert html_text.main_text(other, chain) == "T & U\nAlpha beta. Gamma delta."
    assert html_text.main_text(None, chain) == html_text.main_text("", chain) == html_text.main_text("<script>x", chain) == ""


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    chain = html_text.Chain(rng.normal(size=(2, 30)), rng.normal(size=(2, 2)))
    page = [rng.integers(0, 30, 4).tolist() for _ in range(8)]
    s = chain.scores(page)
    value = lambda y: sum(s[i, a] for i, a in enumerate(y)) + sum(chain.move[a, b] for a, b in zip(y, y[1:]))
    best = max(value([k >> i & 1 for i in range(8)]) for k in range(256))
    assert math.isclose(value(chain.decode(page)), best)


def test_fingerprints(odd):
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.text or ""))
    texts = [r.text or "" for r in rows]
    want = Counter()
    for i, t in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        changed = piecewise_hash.edited(t, following).encode()
        own = piecewise_hash.fingerprint(t.encode())
        near = piecewise_hash.likeness(own, piecewise_hash.fingerprint(following.encode()))
        want[rows[i].doc_id, len(t), hashlib.sha256(changed).hexdigest(), own, near] += 1
    got = piecewise_hash.fingerprint_documents(odd).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.near_next) for r in got) == want
    text = " ".join(random.Random(1).choices(WORDS, k=2000))
    a, b = (piecewise_hash.fingerprint(t.encode()) for t in (text, text[:4000] + "inserted" + text[4000:]))
    assert piecewise_hash.likeness(a, b) > 0.8 and piecewise_hash.likeness(a, a) == 1
    assert piecewise_hash.fingerprint_documents(odd.limit(0)).count() == 0


def test_packing_round_trip(odd, documents):
    tokenizer = token_cache.load_tokenizer(WORD_BPE)
    for df in (odd, documents):
        pieces = packing.pack_documents(df, WORD_BPE).collect()
        ids = {}
        for r in df.collect():
            x = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
            ids.setdefault(r.doc_id, []).append(x)
        for r in pieces:
            assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 and len(x) == r.doc_tokens for x in ids[r.doc_id])
        assert sum(r.length for r in pieces) == sum(len(x) for v in ids.values() for x in v)
        windows = {}
        for r in pieces:
            windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for w in windows.values():
            ends = 0
            for offset, length in sorted(w):
                assert offset == ends
                ends += length
            assert ends <= 4096
    assert packing.pack_documents(odd.limit(0), WORD_BPE).count() == 0


def test_differencing_is_near_equal():
    lengths = random.Random(1).choices(range(1, 1000), k=300)
    sums = [sum(lengths[i] for i in w) for w in packing.difference(lengths, 40)]
    assert sum(sums) == sum(lengths) and max(sums) - min(sums) < 100


def test_language(spark, documents, odd):
    from pipekit.llm.common import crc32_remainder

    held = crc32_remainder("doc_id", 5)
    model = language_id.fit(documents.filter(held != 0))
    got = language_id.identify(documents, model).filter(held == 0).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    none = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert all(none[i].lang_pred == "und" and none[i].rejected for i in (1, 2, 3))
    assert language_id.fit(odd.limit(0)) == {}
    assert language_id.identify(odd.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        language_id.identify(odd.withColumnRenamed("key", "score"), model)


def test_pipeline(spark, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != "packing":
            assert out.columns == documents.columns
        out = out.cache()
        if name == "near_dedup":
            rows = sorted((r.doc_id, r.text) for r in docs.collect())
            assert out.count() == len(set(brute_classes(rows)))
        if name == "repeated_passages":
            want = brute_repeats([r.text for r in docs.collect()], 200)
            assert sum((n * k[0] - n * k[1]) for k, n in want.items()) >= out.selectExpr("sum(octet_length(text))").first()[0]
            assert out.count() == docs.count()
        docs = out
    assert docs.count() > 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_copies_do_not_fill_the_language_sample(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=400)) for _ in range(40)]
    # The text with the smallest hash has more copies than the sample has places.
    hashes = {r.text: r.h for r in spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "xxhash64(text) h").collect()}
    hot = min(texts, key=hashes.get)
    df = spark.createDataFrame([(t, "xx") for t in [*texts, *[hot] * 60]], "text string, lang string")
    found = language_id.fit(df, texts_per_language=20, dictionary_bytes=8_000)["xx"]
    wanted = sorted(texts, key=hashes.get)[:20]
    assert all(t[:90].encode() in found for t in wanted)
    assert all(t[-90:].encode() in found for t in wanted)  # from all of a text
    assert 7_900 <= len(found) <= 8_000
    # A few texts fill the dictionary as well.
    few = language_id.fit(df.filter(df.text.isin(wanted[:2])), dictionary_bytes=3_000)["xx"]
    assert 2_900 <= len(few) <= 3_000


def test_language_shares_and_pieces():
    assert language_id._shares({1: 10, 2: 1_000, 3: 1_000}, 500) == {1: 10, 2: 243, 3: 244}
    data = bytes(range(256)) * 10
    for share in (1, 50, 101, 203, 1_000, 2_559):
        assert len(language_id.spread(data, share)) == share
    assert language_id.spread(data, 1_000).startswith(data[:50]) and language_id.spread(data, 1_000).endswith(data[-50:])
    assert language_id.spread(data, 5_000) == data


def test_copies_do_not_fill_the_page_sample(spark, monkeypatch):
    pages = [f"<html><body><article><p>Text {i} stands here.</p></article></body></html>" for i in range(30)]
    df = spark.createDataFrame([(p,) for p in [*pages, *pages[:10] * 50]], "html string")
    seen = []
    monkeypatch.setattr(html_text, "redress", lambda page, labels, rng: (seen.append(page[0].text), ([], []))[1])
    monkeypatch.setattr(html_text, "train", lambda examples: examples)
    html_text.fit(df, training_pages=20, dresses=1)
    assert len(seen) == len(set(seen)) == 20


def test_katz_splits_heavy_words(spark, monkeypatch):
    """A word with a third of all tokens and the end token are spread; parts of sums are added by Spark."""
    monkeypatch.setattr(katz, "SUM_ROWS", 50)
    monkeypatch.setattr(katz, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(katz, "SAMPLE", 0.5)
    staged, stage = {}, katz.stage_table
    monkeypatch.setattr(katz, "stage_table", lambda df, tag: staged.setdefault(tag, stage(df, tag)))
    rng = random.Random(9)
    texts = [" ".join("hot" if rng.random() < 0.4 else rng.choice(WORDS[:60]) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    df = make(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(4)
    model = katz.katz_scores(df, pairs=True)
    got = Counter(
        (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in model.scores.collect()
    )
    assert sum((got - brute_katz(list(enumerate(texts)))).values()) <= 2
    heavy = {r.n_known for r in staged["katz"].filter("kind = 'e'").select("n_known").distinct().collect()}
    hot = int(katz.hash_words([b"hot"])[0] | np.uint64(4))
    assert heavy == {int(katz.END), hot - (1 << 64) * (hot >> 63)}
    # No task holds the sums of all documents.
    assert staged["katz"].filter("kind = 'd'").groupBy("key").count().agg({"count": "max"}).first()[0] > 4
    want = Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            want.update(zip(["<s>", *t.split()], [*t.split(), None]))
    assert sorted(want.values()) == sorted(r["count"] for r in model.pairs.collect())


@pytest.fixture
def partitions(spark):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, str(n))
    spark.conf.set(name, before)


def test_katz_tokens_of_heavy_words_are_not_joined(spark, monkeypatch, partitions):
    """More partitions mean more heavy words.  Each leaves one row, whatever its tokens; each bucket has a task of its own."""
    monkeypatch.setattr(katz, "SLICE_BYTES", 5_000)
    monkeypatch.setattr(katz, "SAMPLE", 0.9)
    monkeypatch.setattr(katz, "BATCH_TOKENS", 5_000)
    staged, stage = {}, katz.stage_table
    monkeypatch.setattr(katz, "stage_table", lambda df, tag: staged.setdefault(tag, stage(df, tag)))
    rng = random.Random(4)
    texts = []
    for i in range(400):
        words = [f"w{rng.randrange(3000)}" if rng.random() < 0.5 else f"often{rng.randrange(12)}" for _ in range(rng.randrange(60))]
        # A pair of every document, and a heavy word that no training document has.
        texts.append(" ".join([*words, "hot pair", *(["held out"] * 30 if zlib.crc32(str(i).encode()) % 7 == 2 else [])]))
    df = make(spark, [(i, t, "a") for i, t in enumerate(texts)]).repartition(3)
    for n in (1, 7, 50):
        staged.clear()
        partitions(n)
        model = katz.katz_scores(df, pairs=True)
        got = Counter(
            (r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in model.scores.collect()
        )
        assert sum((got - brute_katz(list(enumerate(texts)))).values()) <= 2
        heavy = [r.n_known for r in staged["katz"].filter("kind = 'e'").collect()]
        assert len(heavy) == len(set(heavy)) and (n < 50 or len(heavy) > 12)
        assert len(staged["katz"].inputFiles()) == n
        want = Counter()
        for i, t in enumerate(texts):
            if zlib.crc32(str(i).encode()) % 7 != 2:
                want.update(zip(["<s>", *t.split()], [*t.split(), None]))
        assert sorted(want.values()) == sorted(r["count"] for r in model.pairs.collect())


def test_katz_spreads_hot_pairs():
    """A hot pair's documents lie in many buckets, batch by batch; another pair of heavy words in one."""
    word = {w: int(katz.hash_words([w])[0] | np.uint64(4)) for w in (b"a", b"b", b"c")}
    heavy = np.unique(np.array([katz.END, *word.values()], dtype=np.uint64))
    words, histories = (np.array([word[w]], dtype=np.uint64) for w in (b"b", b"a"))
    frequent = katz._Frequent(heavy, np.array([katz.END, katz.START]), katz._pair_keys(words, histories), words, histories)
    at, times = {b"b": Counter(), b"c": Counter()}, 0
    for number in range(8):
        rows, (_, hot) = katz._dealt([b"a b c"] * 5, np.array([1, 1, 1, 0, 1]), 8, frequent, number)
        times += int(hot[0])
        for bucket, holds, data in rows:
            assert holds == katz._HEAVY
            blob = katz._Blob(0, True, *katz._unpacked(data, frequent.common))
            for w in at:
                at[w][bucket] += word[w] in blob.minor.tolist()
    assert times == 32 and len(+at[b"b"]) == 8 and len(+at[b"c"]) == 1


def test_katz_sums_are_64_bits_wide():
    sums = katz._Sums()
    for _ in range(3):
        sums.add(np.array([7]), {"n_tokens": np.array([2**31 - 1])})
    assert sums.ints[0, 0] == 3 * (2**31 - 1)


def test_packing_ids_of_every_low_code_point():
    """Alone and between letters, against the library; some capitals lower to letters beyond the plain characters."""
    encoder = packing.WordEncoder(WORD_BPE)
    texts = [f"{chr(c)} a{chr(c)}b" for c in range(0x250)] + ["ƏLAVƏ MƏLUMAT", "ƁANGARE", "ƐWE ƆKRA"]
    for text, data in zip(texts, encoder.encode(texts), strict=True):
        expected = token_cache.load_tokenizer(WORD_BPE).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(data, dtype="<u4").tolist() == expected, repr(text)


def test_pages_with_unclosed_elements():
    """The head may stay open, and lists of choices, buttons and drawings end with the next block."""

    def texts(page):
        return [b.text for b in html_text.blocks(page)]

    assert texts("<html><head><title>t</title><body><article><p>One.<p>Two.") == ["One.", "Two."]
    assert texts("<head><meta charset=x><script>x</script><div>One.</div>") == ["One."]
    assert texts("<div><select><option>a<option>b<p>One.</p></div><p>Two.") == ["One.", "Two."]
    assert texts("<div><button>press<p>One.</p></div><svg><path><p>Two.") == ["One.", "Two."]
    assert texts("<p>One <button>x</button> two <textarea>y</textarea> three <select><option>z</select> four.</p>") == ["One two three four."]
    assert texts('<p title="a>b">One.</p><p title="never closed>Two.</p>') == ["One.", "Two."]
    assert texts("<p>1 < 2 <3 and <a href=x>link</a") == ["1 < 2 <3 and link"]
    (block,) = html_text.blocks('<div class="outer"><article id="main"><p>x</p></article></div>')
    assert (block.leaf, block.tags, block.names) == ("p", {"div", "article", "p"}, {"outer", "main"})


@pytest.mark.parametrize(
    "page",
    ["<div>" * 20_000 + "<p>x</p>" * 20_000, "<a " * 300_000, '<a b="' * 150_000, "<p>x" * 200_000, "<li><b>" * 100_000, "<!-- " * 200_000, "</div>" * 150_000 + "<i>" * 50_000],
)
def test_broken_and_deep_pages_take_linear_time(page):
    import time

    start = time.process_time()
    found = html_text.blocks(page)
    half = html_text.blocks(page[: len(page) // 2])
    assert time.process_time() - start < 20 and len(half) <= len(found)


def test_katz_sends_sums_on_before_they_outgrow_their_bound():
    documents, histories, sent = katz._Sums(50), katz._Sums(50), Counter()
    for first in (0, 30, 60):
        docs = np.arange(first, first + 30)
        words, one = (docs + 4).astype(np.uint64), np.ones(30, dtype=np.uint32)
        for batch in katz._merge(words, words, one, one, docs, one, False, documents, histories):
            sent.update(batch.column(0).to_pylist())
        assert len(documents.keys) <= 50 and len(histories.keys) <= 50
    assert sent["d"] == sent["h"] == 60


def test_staged_tables_take_little_room(spark):
    staged = common.stage_table(spark.createDataFrame([("some text",)], "text string"), "room")
    assert staged.collect() == [("some text",)] and all(f.endswith(".zstd.parquet") for f in staged.inputFiles())


def test_katz_packs_the_sums_of_documents(spark, monkeypatch):
    """Sums of documents leave a task as a row for each group of them, not as a row for each document."""
    staged, stage = {}, katz.stage_table
    monkeypatch.setattr(katz, "stage_table", lambda df, tag: staged.setdefault(tag, stage(df, tag)))
    rng = random.Random(3)
    texts = [" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(640)]
    model = katz.katz_scores(make(spark, [(i, t, "a") for i, t in enumerate(texts)]).coalesce(1))
    assert staged["katz"].filter("kind IN ('d', 'm')").count() < 640 / 8
    got = sorted(model.scores.select("doc_id", "n_tokens").collect())
    assert got == [(i, 41) for i in range(640)]


def test_katz_blobs_come_back():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3000):
        words = np.unique(rng.integers(4, 2**64, n, dtype=np.uint64))
        common = np.unique(np.append(words[::3], [katz.END, katz.START]))
        numbers, parts = rng.integers(0, 70_000, n), rng.normal(size=n)
        blob = katz._blob(*katz._coded(words, common), katz._narrow(numbers), parts)
        back = katz._unblob(blob, 5, "uuuuf")
        assert (katz._decoded(*back[:3], common) == words).all() and (back[3] == numbers).all() and (back[4] == parts).all()


def test_staged_rows_reach_python_in_small_batches(spark):
    """Texts of 24 MB in one task; a session's own size holds."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["bytes"])

    texts = spark.range(0, 3000, 1, 1).selectExpr("repeat('some text', 1000) AS text")
    staged = common.stage_table(texts.mapInArrow(sizes, "bytes long"), "sizes").selectExpr("max(bytes)", "sum(bytes)").first()
    assert staged[0] < 10 << 20 and staged[1] > 24 << 20
    own = spark.newSession()
    own.conf.set(common.BATCH_CONF, "32m")
    common.bound_batches(own)
    assert own.conf.get(common.BATCH_CONF) == "32m"


def test_mix_sends_no_blocks_to_the_driver_and_deals_its_slots(spark, monkeypatch):
    """Their plan starts from the sources' few rows, so that Spark takes them for small at any size."""
    from conftest import plan_text
    from pyspark.sql import functions as F

    monkeypatch.setattr(mixing, "CHUNK_SLOTS", 16)
    df = make(spark, [(i, " ".join(WORDS[: 20 + i]), "ab"[i % 2]) for i in range(100)])
    mix = mixing.mix_sources(df, block_words=8)
    joins = re.findall(r"^\(\d+\) (\w+Join).*\nLeft keys \[\d+\]: \[(.*)\]$", plan_text(mix.ranges), re.M)
    assert [kind for kind, keys in joins if "block#" in keys] == ["SortMergeJoin"]
    assert mix.slots.select(F.spark_partition_id()).distinct().count() > 1
    # Every block is taken as often as its source's slots name it.
    uses = Counter((r.rank, r.block) for r in mix.slots.collect())
    assert sum(uses.values()) == mix.sources.agg(F.sum("n_slots")).first()[0] and max(uses.values()) <= 2
    words = mix.ranges.selectExpr("sum((high - low) * uses)").first()[0]
    blocks = {r["rank"]: (r.blocks, r.source_size) for r in mix.sources.collect()}
    sizes = {(k, b): min(8, size - 8 * b) for k, (n, size) in blocks.items() for b in range(n)}
    assert words == sum(n * sizes[x] for x, n in uses.items())
