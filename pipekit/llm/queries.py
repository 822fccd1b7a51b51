"""The operators over their whole tables, with production parameters; SQL where it can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipekit.llm import alignment, bpe_tree, html_text, katz, language_id, line_frequency, mixing, near_duplicates, packing, piecewise_hash, repeats, spelling, token_cache
from pipekit.llm.common import crc32_remainder
from pipekit.sources.tables import read_table

QUERIES = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.line_frequency(read_table(spark, sf_dir, "documents")).drop("host")


@query
def op2_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache.cached_token_counts(read_table(spark, sf_dir, "documents"), BYTE_BPE, ranks=BYTE_RANKS)


@query
def op3_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept_text")


@query
def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(read_table(spark, sf_dir, "documents")).scores


@query
def op5_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix_sources(read_table(spark, sf_dir, "documents")))


@query
def op7_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit(pages))


@query
def op8_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise_hash.fingerprint_documents(read_table(spark, sf_dir, "documents"))


@query
def op9_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), WORD_BPE)


@query
def op10_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    remainder = crc32_remainder("doc_id", 5)
    model = language_id.fit(docs.filter(remainder != 0))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (remainder == 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query
def op11_edit_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(read_table(spark, sf_dir, "documents"))


@query
def op12_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.encode_documents(read_table(spark, sf_dir, "documents"), WORD_BPE)


@query
def op13_fragment_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(read_table(spark, sf_dir, "documents"), BYTE_RANKS, PIECE_MODEL)
