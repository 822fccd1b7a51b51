"""Mixing sources to target weights, in DataFrame functions only.

Each source's documents, in a fixed pseudorandom order, form one stream of words, packed into blocks of
``block_words``.  Targets are the weighted shares of the mix, stopped at ``max_repeats`` times a source's size, the
excess reshared by weight.  A source fills as many slots as its target holds blocks.  Every slot draws its output shard, so
a shard's counts over the sources are multinomial, conditioned on the sources' totals (which therefore meet their
targets to within a block).  Slot i of a source takes the block at ``i mod blocks`` under a pseudorandom permutation of
the source's block numbers (swap-or-not rounds, exact for any number of blocks), so no block is taken more than
``max_repeats`` times.  Slots and documents' ranges join by source and block number.

Streams are laid out by prefix sums over chunks, so a source may hold any share of the rows; slots are made in chunks
too, dealt over tasks.  Blocks' uses, which grow with the corpus, meet the documents' ranges by a sort-merge join: Spark's
estimate of their size is that of the sources' few rows, which would broadcast them.  One row per source is ranked in one task; the sources join by broadcast while there are at most
``BROADCAST_SOURCES`` of them (a row of eight numbers each), and by a plain join beyond.

NULL texts and texts without words have size 0 and are never taken.  A NULL source is a source, ranked last.  Repeated rows
are documents of their own.  Ties in the order are rows of equal id and content, which may change places without
changing the result.  Empty input gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pipekit.llm.common import WORD, stage_table, text_or_empty

WEIGHTS = (5, 2, 1)
MIX_SHARE = 1.5
MAX_REPEATS = 2
BLOCK_WORDS = 128
SHARD_SLOTS = 8192
CHUNK_DOCUMENTS = 20_000
CHUNK_SLOTS = 65_536
BROADCAST_SOURCES = 100_000
ROUNDS = 8
SEED = 20


@dataclass(frozen=True)
class Mix:
    """``sources``: sizes, targets, slots.  ``slots``: shard and block of each slot.  ``ranges``: each document's words
    in each block (``low`` to ``high`` within the document) with the block's ``uses``.  ``documents``: the staged rows."""

    sources: DataFrame
    slots: DataFrame
    ranges: DataFrame
    documents: DataFrame


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = MIX_SHARE, most: float = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``): shares by weight, none above its cap."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", pick.cast("double"))
    everything = Window.partitionBy()
    cap = most * F.col("source_size")
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("mix") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = (
        ranked.withColumn("cap", cap.cast("double"))
        .withColumn("mix", share * F.sum("source_size").over(everything))
        .withColumn("level", level)
    )
    # The level is that of the first source, by cap per weight, which it leaves below its cap.
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))
    found = levelled.withColumn("chosen", F.min(fits).over(everything)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("chosen") * F.col("weight"), F.col("cap")))
    return found.select("source", "rank", "weight", "source_size", "n_documents", target.alias("target"))


def permuted(index: Column, size: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Swap-or-not: a pseudorandom permutation of 0 .. size - 1."""

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), key, r), size) - x, size)
        return F.when(F.xxhash64(key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index, swap)


def mix_sources(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: list[str] | None = None,
    weights=WEIGHTS,
    share: float = MIX_SHARE,
    block_words: int = BLOCK_WORDS,
) -> Mix:
    """Draws the mix.  ``keep`` names columns that stay with the staged documents (``_row`` identifies them)."""
    staged = stage_table(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(doc_id).cast("long").alias("_id"),
            F.col(source).cast("string").alias("_source"),
            F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("_size"),
            F.xxhash64(text_or_empty(text)).alias("_content"),
            *[F.col(c) for c in keep or []],
        ),
        "mix",
    )
    sizes = staged.groupBy(F.col("_source").alias("source")).agg(
        F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("n_documents")
    )
    blocks = F.ceil(F.col("source_size") / block_words)
    n_slots = F.least(F.round(F.col("target") / F.col("source_size") * F.col("blocks")).cast("long"), 2 * F.col("blocks"))
    sources = source_targets(sizes, weights, share).withColumn("blocks", blocks).withColumn(
        "n_slots", F.when(F.col("blocks") > 0, n_slots).otherwise(F.lit(0)).cast("long")
    )
    sources = stage_table(sources, "mix-sources")
    totals = sources.agg(F.count(F.lit(1)), F.sum("n_slots"), F.sum(F.ceil(F.col("n_slots") / CHUNK_SLOTS))).first()
    small = F.broadcast if totals[0] <= BROADCAST_SOURCES else lambda df: df
    shards = max(1, -(-(totals[1] or 0) // SHARD_SLOTS))
    # A given number, since chunks are a few rows that would else be put into one task before they grow.
    tasks = max(1, min(totals[2] or 0, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    first = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n_slots - 1) div {CHUNK_SLOTS}"))).alias("part")
    last = F.least(F.col("n_slots"), (F.col("part") + 1) * CHUNK_SLOTS) - 1
    slots = (
        sources.filter("n_slots > 0")
        .select("rank", "blocks", "n_slots", first)
        .repartition(tasks, "rank", "part")
        .select("rank", "blocks", F.explode(F.sequence(F.col("part") * CHUNK_SLOTS, last)).alias("slot"))
        .select(
            "rank",
            "slot",
            F.pmod(F.xxhash64(F.lit("shard"), "rank", "slot"), F.lit(shards)).alias("shard"),
            permuted(F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"), F.col("rank")).alias("block"),
        )
    )
    uses = slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("uses"))

    chunks = F.ceil(F.col("n_documents") / CHUNK_DOCUMENTS)
    placed = (
        staged.select("_row", "_id", "_source", "_size", "_content")
        .join(small(sources.select("source", "rank", "n_documents")), F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("chunk", F.pmod(F.xxhash64("_id", "_content"), chunks))
    )
    chunk_sizes = placed.groupBy("rank", "chunk").agg(F.sum("_size").alias("chunk_size"))
    earlier = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunk_starts = chunk_sizes.select(
        F.col("rank"), F.col("chunk"), F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)).alias("chunk_start")
    )
    running = Window.partitionBy("rank", "chunk").orderBy("_id", "_content", "_row").rowsBetween(Window.unboundedPreceding, 0)
    laid = (
        placed.filter("_size > 0")
        .withColumn("end", F.sum("_size").over(running))
        .join(chunk_starts, ["rank", "chunk"])
        .select("_row", "rank", "_size", (F.col("chunk_start") + F.col("end")).alias("end"))
        .withColumn("start", F.col("end") - F.col("_size"))
    )
    in_blocks = laid.select(
        "*", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(end - 1) div {block_words}"))).alias("block")
    )
    low = F.greatest(F.col("start"), F.col("block") * block_words) - F.col("start")
    high = F.least(F.col("end"), (F.col("block") + 1) * block_words) - F.col("start")
    ranges = in_blocks.join(uses.hint("merge"), ["rank", "block"]).select(
        "_row", low.cast("int").alias("low"), high.cast("int").alias("high"), "uses"
    )
    return Mix(sources, slots, ranges, staged)


def taken_words(mix: Mix) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``."""
    taken = mix.ranges.groupBy("_row").agg(F.sum((F.col("high") - F.col("low")) * F.col("uses")).alias("taken"))
    n_sources = mix.sources.count()
    sources = mix.sources.select("source", "source_size", "target")
    sources = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    return (
        mix.documents.select("_row", "_id", "_source", "_size")
        .join(taken, "_row", "left")
        .join(sources, F.col("_source").eqNullSafe(F.col("source")))
        .select(
            F.col("_id").alias("doc_id"),
            F.col("_size").alias("size"),
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def mixed_documents(mix: Mix, columns: list[str], *, text: str = "text") -> DataFrame:
    """The mix as documents: one row per document and repeat with the words taken, the ``columns`` kept."""
    turns = mix.ranges.select("_row", "low", "high", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int"))).alias("_turn"))
    taken = turns.groupBy("_row", "_turn").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("_ranges"))
    words = F.regexp_extract_all(F.col(text), F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    pieces = F.transform("_ranges", lambda r: F.slice(F.col("_words"), r["low"] + 1, r["high"] - r["low"]))
    joined = mix.documents.join(taken, "_row").withColumn("_words", words)
    return joined.withColumn(text, F.rtrim(F.concat_ws("", F.flatten(pieces)))).select(*columns)
