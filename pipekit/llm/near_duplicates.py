"""Near-duplicate documents by BagMinHash signatures.

A document is its multiset of five-word shingles (lower-cased words; a text of one to four words is one shingle).  Two
documents are linked if the weighted Jaccard likeness of their multisets is at least ``similarity``; a class is a
connected component of links.

Signatures: every element has a Poisson process over its discretised weight, split hierarchically into the weight
intervals [0,1), [1,2), [2,4), [4,8) ...  A point has a time, a weight level and one of ``bands * rows`` components, and
belongs to a document if its level is below the element's count.  A component's value is its earliest point; two
documents agree in it with a probability equal to their weighted Jaccard likeness.  Times are drawn only up to where
every component is expected to be hit, and further if one is not.

Links: bands of ``rows`` components make buckets.  In each bucket the members meet one hub, pairs are verified by exact
multiset overlap, and components are formed.  Buckets whose members are still in several components go on with ``GROWTH``
times as many hubs a round, each against members of other components only, until every such pair has been tested once.
A round cuts a bucket into tiles of about ``TILE`` members by ``TILE`` hubs; a task holds one tile with its multisets.  A pair
is verified if it passes a bound (counts summed into ``BINS`` bins can only overlap more than the multisets do) and its two
are not yet in one component by the links that the tile has found: those could join nothing.  So a tile gives at most one
link per member, a group of copies costs one pair a member, and no pair is ever a row.  Between rounds labels
take two steps towards their components, which only saves pairs; whole components of all links are formed at the end.  A
pair at the limit shares no band with probability ``(1 - similarity ** rows) ** bands`` (3e-5); nothing else is lost.

Equal multisets are one node from the start.  Text is shuffled once, for the documents that are in a bucket with others.
NULL texts and texts without words are classes of their own.  Repeated rows are in one class.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipekit.llm.common import SHINGLE_WORDS, SIMILARITY, content_key, hash_words, mix64, stage_table, text_or_empty

BANDS = 26
ROWS = 5
#: Each round takes this many times the hubs of the last.
GROWTH = 64
#: Members, and hubs, of a tile.
TILE = 2048
#: Multisets that leave a task together.
BAGS_AT_ONCE = 500
#: Bins of the overlap bound; multisets with over 255 shingles in one are tested without it.
BINS = 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of a text, ascending, and their counts."""
    words = (text or "").lower().encode().split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = hash_words(words)
    width = min(width, len(h))
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        s = np.full(n, width, dtype=np.uint64)
        for i in range(width):
            s = mix64(s * _GOLDEN + h[i : i + n])
    return np.unique(s, return_counts=True)


#: Elements and expected points that are worked on at once.
CHUNK_POINTS = 60_000


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """BagMinHash values of non-empty multisets, a row each."""
    out = np.empty((len(bags), size), np.uint64)
    expected = size * (np.log(size) + 4.0)
    due = np.arange(len(bags))
    until = np.array([expected / counts.sum() for _, counts in bags])
    while len(due):
        load = np.cumsum([len(bags[i][0]) + expected for i in due])
        missed = []
        for part in np.split(due, np.flatnonzero(np.diff(load // CHUNK_POINTS)) + 1):
            values, whole = _earliest([bags[i] for i in part], until[part], size)
            out[part] = values
            missed.append(part[~whole])
        due = np.concatenate(missed)
        until[due] *= 2
        expected *= 2
    return out


def _earliest(bags, until: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Name of the earliest point of each component of each multiset; whether all of its components had one."""
    elements = np.concatenate([e for e, _ in bags])
    counts = np.concatenate([c for _, c in bags])
    owners = np.repeat(np.arange(len(bags)), [len(e) for e, _ in bags])
    keys, limits, lows, owned = [elements], [counts], [np.zeros(len(counts))], [owners]
    lengths = [np.ones(len(counts))]
    level = 1
    while True:  # weight interval [level, 2 * level) of the elements that reach into it
        into = counts > level
        if not into.any():
            break
        with np.errstate(over="ignore"):
            keys.append(mix64(elements[into] + np.uint64(level) * _GOLDEN))
        limits.append(counts[into])
        owned.append(owners[into])
        lows.append(np.full(into.sum(), float(level)))
        lengths.append(np.full(into.sum(), float(level)))
        level *= 2
    slots, times, names = _points(*map(np.concatenate, (keys, limits, lows, lengths, owned)), size, until)
    late_first = np.argsort(times, kind="stable")[::-1]
    out = np.zeros(len(bags) * size, np.uint64)
    hit = np.zeros(len(bags) * size, bool)
    out[slots[late_first]] = names[late_first]  # the earliest is written last
    hit[slots] = True
    return out.reshape(-1, size), hit.reshape(-1, size).all(axis=1)


def _points(key, limit, low, length, owner, size: int, until: np.ndarray):
    """Component (of all multisets in a row), time and name of the accepted points up to each multiset's time."""
    components, times, names = [], [], []
    t = np.zeros(len(key))
    step = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(key):
            step += np.uint64(1)
            h = mix64(key + step * _GOLDEN)
            t = t - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
            go = t < until[owner]
            key, limit, low, length, owner, t, h = key[go], limit[go], low[go], length[go], owner[go], t[go], h[go]
            name = mix64(h ^ _GOLDEN)
            inside = np.floor(low + length * ((name >> np.uint64(40)).astype(np.float64) * 2.0**-24)) < limit
            component = (((name & np.uint64(0xFFFFFFFF)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)
            components.append((owner * size + component)[inside])
            times.append(t[inside])
            names.append(name[inside])
    return np.concatenate(components), np.concatenate(times), np.concatenate(names)


def signature(elements: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """BagMinHash values of a non-empty multiset."""
    return signatures([(elements, counts)], size)[0]


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """Bucket keys of signatures, a row each."""
    rows = values.reshape(len(values), bands, values.shape[1] // bands)
    with np.errstate(over="ignore"):
        out = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(values), 1))
        for i in range(rows.shape[2]):
            out = mix64(out * _GOLDEN + rows[:, :, i])
    return out.view(np.int64)


def overlap(a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray) -> float:
    """Weighted Jaccard likeness of two multisets with ascending elements."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = np.minimum(a_counts[i], b_counts[j]).sum()
    return float(common / (a_counts.sum() + b_counts.sum() - common))


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())


def _sign(bands: int, rows: int):
    def run(batches):
        for batch in batches:
            digests, keys, texts, at = [], [], batch.column(3), 0
            while at < batch.num_rows:
                own, first, load = {}, at, 0  # equal multisets are signed once
                while at < batch.num_rows and load < CHUNK_POINTS:
                    elements, counts = shingles(texts[at].as_py())
                    load += len(elements)
                    digests.append(xxhash.xxh3_128_digest(elements.tobytes() + counts.tobytes()) if len(elements) else None)
                    if len(elements):
                        own[digests[-1]] = (elements, counts)
                    at += 1
                signed = band_keys(signatures(list(own.values()), bands * rows), bands)
                of = dict(zip(own, signed, strict=True))
                keys += [of.get(d) for d in digests[first:at]]
            first, second = (
                [None if d is None else int.from_bytes(d[k : k + 8], "little", signed=True) for d in digests] for k in (0, 8)
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(keys, _LONGS)],
                names=["doc_id", "k1", "k2", "m1", "m2", "bands"],
            )

    return run


def _bags(batches):
    for batch in (large.slice(at, BAGS_AT_ONCE) for large in batches for at in range(0, large.num_rows, BAGS_AT_ONCE)):
        found = [shingles(t.as_py()) for t in batch.column(1)]
        binned = [np.bincount((e % np.uint64(BINS)).astype(np.int64), weights=c, minlength=BINS) for e, c in found]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([e.view(np.int64) for e, _ in found], _LONGS),
                pa.array([c.astype(np.int32) for _, c in found], _INTS),
                pa.array([x.astype("u1").tobytes() if x.max() < 256 else None for x in binned], pa.binary()),
            ],
            names=["node", "elements", "counts", "bins"],
        )


_LANES = np.uint64(0x00FF00FF00FF00FF)


def _common(bins: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Overlap of each row of bins with one other row; four 16-bit lanes of a word are added at once."""
    least = np.minimum(bins, other).view(np.uint64)
    with np.errstate(over="ignore"):
        lanes = ((least & _LANES) + ((least >> np.uint64(8)) & _LANES)).sum(axis=1)
        low, high = lanes & np.uint64(0x0000FFFF0000FFFF), (lanes >> np.uint64(16)) & np.uint64(0x0000FFFF0000FFFF)
        both = low + high
        return ((both & np.uint64(0xFFFFFFFF)) + (both >> np.uint64(32))).astype(np.int64)


def _tile_links(node, label, is_hub, as_hub, valid, bins, totals, bag, similarity: float):
    """Links between a tile's members and hubs that join different components.

    Components known so far are ``label``; a link found joins two, and pairs within one are not looked at again.  So a
    tile gives at most as many links as it has labels, however many of its pairs are alike."""
    _, root = np.unique(label, return_inverse=True)
    mine = np.flatnonzero(~as_hub)
    order = mine[np.argsort(totals[mine], kind="stable")]  # alike multisets have alike sizes
    sizes, loose = totals[order[valid[order]]], order[~valid[order]]
    order = order[valid[order]]
    for h in np.flatnonzero(as_hub):
        if valid[h]:
            lo = np.searchsorted(sizes, similarity * totals[h] - 1e-6)
            hi = np.searchsorted(sizes, totals[h] / similarity + 1e-6, "right")
            near = order[lo:hi]
        else:
            near = order
        near = near[(root[near] != root[h]) & (~is_hub[near] | (node[near] < node[h]))]
        if valid[h] and len(near):
            common = _common(bins[near], bins[h])
            near = near[common >= similarity * (totals[near] + totals[h] - common) - 1e-9]
        more = loose[(root[loose] != root[h]) & (~is_hub[loose] | (node[loose] < node[h]))] if len(loose) else loose
        for i in np.concatenate((near, more)).tolist():
            if root[i] != root[h] and overlap(*bag(i), *bag(h)) >= similarity:
                yield min(node[i], node[h]), max(node[i], node[h])
                root[root == root[i]] = root[h]


def _links_of_tiles(similarity: float):
    """The links found in tiles.  Rows come sorted by tile; one tile is held at a time."""

    def tile(rows: pa.Table):
        node, label, is_hub, as_hub = (rows.column(i).to_numpy() for i in range(3, 7))
        valid = rows.column(7).is_valid().to_numpy()
        blank = bytes(BINS)
        bins = np.frombuffer(b"".join(x or blank for x in rows.column(7).to_pylist()), dtype="u1").reshape(-1, BINS)
        totals = bins.sum(axis=1, dtype=np.int64)
        elements, counts = rows.column(8).chunk(0), rows.column(9).chunk(0)

        def bag(i: int) -> tuple[np.ndarray, np.ndarray]:
            return elements[i].values.to_numpy().view(np.uint64), counts[i].values.to_numpy()

        yield from _tile_links(node, label, is_hub, as_hub, valid, bins, totals, bag, similarity)

    def links(rows: pa.Table):
        found = list(tile(rows.combine_chunks()))
        if found:
            a, b = (np.array(x, dtype=np.int64) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), batch.num_rows]
            for at, until in zip(cuts, cuts[1:], strict=False):
                own = tuple(keys[at].tolist())
                if own != key and held:
                    yield from links(pa.Table.from_batches(held))
                    held = []
                key = own
                held.append(batch.slice(at, until - at))
        if held:
            yield from links(pa.Table.from_batches(held))

    return run


def _tiled_links(due: DataFrame, bags: DataFrame, share: float, similarity: float) -> DataFrame:
    """Links (a, b) of a round: ``due`` has bucket, node, label, members and is_hub."""
    m_blocks = F.ceil(F.col("members") / F.lit(float(TILE))).cast("int")
    h_blocks = F.ceil(F.least(F.col("members").cast("double"), F.lit(share)) / F.lit(float(TILE))).cast("int")
    place = F.xxhash64("node")
    member = due.select(
        "bucket", F.pmod(place, m_blocks).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), h_blocks - 1)).alias("j"),
        "node", "label", "is_hub", F.lit(False).alias("as_hub"),
    )
    hub = due.filter("is_hub").select(
        "bucket", F.explode(F.sequence(F.lit(0), m_blocks - 1)).alias("i"), F.pmod(place, h_blocks).cast("int").alias("j"),
        "node", "label", "is_hub", F.lit(True).alias("as_hub"),
    )
    rows = member.unionByName(hub).join(bags, "node")
    columns = ["bucket", "i", "j", "node", "label", "is_hub", "as_hub", "bins", "elements", "counts"]
    tiles = rows.select(columns).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return stage_table(tiles.mapInArrow(_links_of_tiles(similarity), "a long, b long").distinct(), "links")


def _verify(similarity: float):
    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            for i in range(batch.num_rows):
                x, xc, y, yc = (batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in range(2, 6))
                order_x, order_y = x.view(np.uint64), y.view(np.uint64)
                keep.append(overlap(order_x, xc, order_y, yc) >= similarity)
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(kept), b.filter(kept)], names=["a", "b"])

    return run


def _linked(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets are alike enough."""
    left = bags.select(F.col("node").alias("a"), F.col("elements").alias("ea"), F.col("counts").alias("ca"))
    right = bags.select(F.col("node").alias("b"), F.col("elements").alias("eb"), F.col("counts").alias("cb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "ca", "eb", "cb")
    return stage_table(both.mapInArrow(_verify(similarity), "a long, b long"), "links")


def components(nodes: DataFrame, edges: DataFrame, steps: int | None = None) -> DataFrame:
    """(node, label): the smallest node of each component, by neighbours' minima and pointer jumping.  With ``steps``, a
    label may still be above the smallest; equal labels are in one component all the same."""
    both = stage_table(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = stage_table(nodes.select("node", F.col("node").alias("label")), "labels")
    done = 0
    while True:
        offered = both.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("label").alias("offer"))
        better = labels.join(offered, F.col("node") == F.col("b"), "left").select(
            "node", "label", F.least("label", F.coalesce("offer", "label")).alias("lower")
        )
        parents = labels.select(F.col("node").alias("parent"), F.col("label").alias("above"))
        jumped = better.join(parents, F.col("lower") == F.col("parent")).select(
            "node", F.least("lower", "above").alias("label"), (F.least("lower", "above") < F.col("label")).alias("moved")
        )
        staged = stage_table(jumped, "labels")
        labels = staged.select("node", "label")
        done += 1
        if done == steps or not staged.filter("moved").take(1):
            return labels


def _joined(labels: DataFrame, links: DataFrame, steps: int | None = None) -> DataFrame:
    """The labels after more links: components of the components that they join."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(
        labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b"
    )
    edges = stage_table(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).filter("a <> b").distinct(), "links")
    touched = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    lower = components(touched, edges, steps).select(F.col("node").alias("label"), F.col("label").alias("lower"))
    new = labels.join(lower, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    return stage_table(new, "labels")


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``k1``, ``k2`` (the content key), ``class_id`` (the smallest doc_id of the
    class) and ``kept`` (true for one row of each class)."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *content_key(text), text_or_empty(text).alias("text"))
    signed = stage_table(
        keyed.mapInArrow(
            _sign(bands, rows), "doc_id long, k1 long, k2 long, m1 long, m2 long, bands array<long>"
        ).withColumn("row", F.monotonically_increasing_id()),
        "signatures",
    )
    # One node per multiset; equal multisets have equal bands.
    nodes = stage_table(
        signed.filter(F.col("m1").isNotNull())
        .groupBy("m1", "m2")
        .agg(F.min(F.struct("row", "k1", "k2")).alias("least"), F.first("bands").alias("bands"))
        .select("m1", "m2", F.col("least.row").alias("node"), "least.k1", "least.k2", "bands"),
        "nodes",
    )
    entries = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = (
        entries.groupBy("bucket")
        .agg(F.min("node").alias("hub"), F.max("node").alias("top"), F.count(F.lit(1)).alias("members"))
        .filter("hub < top")
    )
    shared = stage_table(entries.join(buckets.drop("top"), "bucket"), "buckets")
    involved = shared.select("node").distinct()
    texts = keyed.join(nodes.join(involved, "node").select("k1", "k2", "node"), ["k1", "k2"])
    bags = stage_table(
        texts.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(
            _bags, "node long, elements array<long>, counts array<int>, bins binary"
        ),
        "bags",
    )
    edges = _linked(shared.filter("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), bags, similarity)
    labels = components(involved, edges)
    links = None
    left = shared.select("bucket", "node", "members")
    share, before = float(GROWTH), 0.0
    while True:
        marked = left.select("bucket", "node", "members").join(labels, "node")
        mixed = marked.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
        left = stage_table(marked.join(mixed.select("bucket"), "bucket"), "mixed")
        largest = left.agg(F.max("members")).first()[0]
        if largest is None or before >= largest:
            break
        # Members draw a place in (0, 1]; this round's hubs are those between last round's share of the bucket and this one's.
        # Earlier hubs have met everyone; two hubs of a round meet once.
        place = (F.pmod(F.xxhash64("node", "bucket"), F.lit(1 << 30)) + 1) / F.lit(float(1 << 30))
        due = left.filter(place > F.lit(before) / F.col("members")).withColumn("is_hub", place <= F.lit(share) / F.col("members"))
        found = _tiled_links(due, bags, share, similarity)
        if found.take(1):
            labels = _joined(labels, found, steps=2)
            links = found if links is None else links.union(found)
        share, before = share * GROWTH, share
    if links is not None:
        labels = _joined(labels, links)

    # Classes: of multisets, then of rows.
    of_node = nodes.select("m1", "m2", "node").join(labels, "node", "left")
    of_node = of_node.select("m1", "m2", F.coalesce("label", "node").alias("label"))
    rows_of = signed.select("row", "doc_id", "k1", "k2", "m1", "m2").join(of_node, ["m1", "m2"], "left")
    labelled = stage_table(rows_of.select("row", "doc_id", "k1", "k2", F.coalesce("label", "row").alias("label")), "classes")
    # Of equal smallest ids the first row by content stays, so that reruns agree.
    chosen = labelled.groupBy("label").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "k1", "k2", "row")).alias("c"))
    chosen = chosen.join(labelled.select("row", F.col("doc_id").alias("class_id")), F.col("c.row") == F.col("row"))
    return labelled.join(chosen.select("label", "class_id", F.col("row").alias("kept_row")), "label").select(
        "doc_id", "k1", "k2", "class_id", (F.col("row") == F.col("kept_row")).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class."""
    kept = near_duplicates(docs, doc_id=doc_id, text=text, **options).filter("kept").select("doc_id", "k1", "k2")
    keyed = docs.select("*", *(c.alias(f"_{n}") for c, n in zip(content_key(text), ("k1", "k2"), strict=True)))
    same = F.col(f"d.{doc_id}").eqNullSafe(F.col("k.doc_id")) & (F.col("_k1") == F.col("k1")) & (F.col("_k2") == F.col("k2"))
    joined = keyed.alias("d").join(kept.alias("k"), same, "left_semi")
    # Rows equal in id and text are one document; the key decides between them.
    return joined.dropDuplicates([doc_id, "_k1", "_k2"]).drop("_k1", "_k2")
