"""A training corpus from raw documents: language ID, near-dedup, repeated passages, mixing, packing.

``run(spark, sf_dir)`` applies the stages in order; each stage's result is written to the shared folder and read back
as the next one's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipekit.llm import language_id, mixing, near_duplicates, packing, repeats
from pipekit.llm.common import stage_table
from pipekit.llm.queries import WORD_BPE
from pipekit.sources.tables import read_table

#: The later stages encode, draw and hash rows, which SQL has no form for; the tests hold them against brute force.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a clear margin; the others go."""
    found = language_id.identify(docs, language_id.fit(docs), prefix="_")
    return found.filter("NOT _rejected").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_duplicates.without_near_duplicates(docs).select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of strings that occur elsewhere too; every document stays."""
    carry = [c for c in docs.columns if c not in ("text", "n_chars")]
    cut = repeats.remove_repeats(docs, carry=carry, with_text=True)
    text = F.col("kept_text")
    return cut.select(*carry, text.alias("text"), F.char_length(text).cast("long").alias("n_chars")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row for each document and repeat."""
    drawn = mixing.mix_sources(docs, keep=docs.columns)
    taken = mixing.mixed_documents(drawn, docs.columns)
    return taken.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in near-equal windows of at most 4096 tokens."""
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return docs
