"""The training-data pipeline: five stages over `documents`, each written and read again before the next one starts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import bpe, decontaminate, ngram_join, quality_rules, sentence_spans
from threadloom.session import saved

#: Byte-pair encoding cannot be said in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule."""
    return quality_rules.judge(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group linked by four fifths of common five-word shingles: the one of the smallest id.

    Documents without words are linked with nothing and stay.  Rows of one id stay or go together; documents without an id
    cannot be told apart, so all of them stay if one of them stands for its group.
    """
    groups = ngram_join.jaccard_components(docs, width=5, percent=80)
    keep = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["kept_id"]), "left_semi").select(*docs.columns)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentence spans that an earlier document has; a document of which nothing is left goes.

    A null text or one without words has nothing to remove and stays.
    """
    shorter = sentence_spans.deduplicate(docs).where("n_removed < n_units OR n_removed = 0")
    return shorter.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and digests of the ids and of the bytes they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(docs, path, public_tokenizers.PATTERN, with_ids=True).drop("text", "n_chars")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_spans),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
