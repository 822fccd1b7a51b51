"""Token counts with a digest cache.

The cache is a Parquet folder of (content digest, tokenizer digest, count).  Documents are digested in the JVM;
their digests join the stored counts, one text per missing digest is encoded, and the new counts are appended.
Equal texts meet inside each task before the shuffle (``first`` per digest), so large groups of copies do not
travel; texts whose digests are stored do not travel at all.

Normalisation maps NULL to the empty text and otherwise keeps the text as it is, since anything else could change
its tokens.  Repeated rows get equal counts.  Two jobs that append at once may store a digest twice with the same
count; readers take one.  Extra columns are ignored.

Encoding uses the rank form of the same vocabulary, which gives the same ids several times faster; texts holding
a special string are given to the .json form's own library.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipekit.llm.common import text_or_empty
from pipekit.session import scratch_path

MAX_TOKENS = 512
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task owns one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def load_ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_digest(path: str) -> str:
    """Names the vocabulary version in the cache."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def count_tokens(texts: list[str], path: str, ranks: str | None) -> list[int]:
    tokenizer = load_tokenizer(path)
    if ranks is None:
        return [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    fast = load_ranks(ranks)
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return [
        len(tokenizer.encode(t, add_special_tokens=False).ids)
        if any(s in t for s in special)
        else len(fast.encode_ordinary(t))
        for t in texts
    ]


def _encoder(path: str, ranks: str | None):
    def encode(batches):
        for batch in batches:
            counts = count_tokens(batch.column(1).to_pylist(), path, ranks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return encode


def cached_token_counts(
    docs: DataFrame,
    tokenizer: str,
    *,
    ranks: str | None = None,
    cache: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    max_tokens: int = MAX_TOKENS,
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``tokenizer`` is a .json vocabulary, ``ranks`` optionally its rank form, ``cache`` the folder of stored counts
    (a new one in the shared folder if it is not given).
    """
    spark = docs.sparkSession
    cache = cache or scratch_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer)
    content = text_or_empty(text)
    keyed = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        content.alias("content"),
        F.unhex(F.sha2(content, 256)).alias("digest"),
    )
    spark.createDataFrame([], CACHE_SCHEMA).coalesce(1).write.mode("append").parquet(cache)  # the folder exists from here on
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    wanted = keyed
    if not stored.isEmpty():
        wanted = keyed.join(stored.select("digest").distinct(), "digest", "left_anti")
    misses = wanted.groupBy("digest").agg(F.first("content").alias("content"))
    counted = misses.mapInArrow(_encoder(tokenizer, ranks), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = (
        spark.read.schema(CACHE_SCHEMA)
        .parquet(cache)
        .filter(F.col("tokenizer") == version)
        .groupBy("digest")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
    sizes = keyed.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes"))
    return sizes.join(counts, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit")
    )
