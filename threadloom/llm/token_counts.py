"""Token counts through a digest cache: known (content, tokenizer) digests are looked up, only distinct misses are encoded.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens).  Appends are idempotent: a digest that two
writers add at the same time carries the same count, and readers take one row per digest.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import slices
from threadloom.session import shared_folder

CACHE = "content_digest string, tokenizer_digest string, n_tokens bigint"
#: Bytes of text handed to the tokenizer at once.
PIECE = 1 << 18


def tokenizer_digest(path: str) -> str:
    """The version of a tokenizer is the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


@lru_cache(maxsize=4)
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs one task per core
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encode_counts(texts: DataFrame, text: str, path: str) -> DataFrame:
    """Replace the text column of (content_digest, text) by its number of tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for piece in slices(batches, text, PIECE):
            n = counter(piece.column(text).fill_null("").to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column("content_digest"), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

    return texts.mapInArrow(count, "content_digest string, n_tokens bigint")


def read_cache(spark, path: str, version: str) -> DataFrame:
    """The counts stored for one tokenizer version; a cache that does not exist yet is empty."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer_digest") == version).groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    cache: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    normalise: Callable[[Column], Column] = lambda c: c,
) -> DataFrame:
    """(key, n_bytes, n_tokens) per row of `docs`.

    `tokenizer` is a file every executor can read; `cache` a folder all of them share (a fresh one if not given).
    `normalise` has to keep the tokenizer's result, e.g. lower case for a tokenizer that lowers its input; the byte-level
    vocabulary sees every byte, so the default leaves texts alone.

    Null texts count as empty (0 tokens); null keys are kept; repeated rows give repeated results; other columns are not
    read.  Of equal texts only one is encoded: its row is found on narrow (digest, key) rows, so no task gathers the copies.
    """
    spark = docs.sparkSession
    cache = cache or shared_folder(spark, "token-cache")
    version = tokenizer_digest(tokenizer)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("__key"), body.alias("__text")).withColumn("content_digest", F.sha2(normalise(F.col("__text")), 256))
    narrow = rows.select("__key", "content_digest", F.octet_length("__text").cast("bigint").alias("n_bytes"))
    known = read_cache(spark, cache, version)
    misses = (
        narrow.groupBy("content_digest")
        .agg(F.min("__key").alias("__owner"))
        .join(known, "content_digest", "left_anti")
    )
    owned = rows.join(
        misses, (rows["content_digest"] == misses["content_digest"]) & rows["__key"].eqNullSafe(misses["__owner"]), "left_semi"
    )
    counted = encode_counts(owned.select("content_digest", normalise(F.col("__text")).alias("__text")), "__text", tokenizer)
    counted.select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens").write.mode("append").parquet(cache)
    stored = read_cache(spark, cache, version)
    return narrow.join(stored, "content_digest", "left").select(F.col("__key").alias(key), "n_bytes", "n_tokens")
