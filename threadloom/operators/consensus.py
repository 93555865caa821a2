"""Agreement between answers to one prompt, and choice of a model for a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import ordered
from threadloom.functions import text as T
from threadloom.functions.tiles import common_counts, in_tiles, incidence

STRONG, PARTIAL = 0.4, 0.2
NO_SCORE = 0.5
NO_CLASS_CONFIDENCE = 0.3


def valid_answers(answers: DataFrame) -> DataFrame:
    """Answers without error and with some text, with their key phrases."""
    ok = ~F.coalesce("error", F.lit(False)) & (T.strip("content") != "")
    return answers.where(ok).select("prompt_id", "answer_id", T.phrases("content").alias("phrases"))


def _similarity(table: pa.Table, left: np.ndarray, right: np.ndarray) -> pa.Table:
    """Sum over the pairs of a tile: Jaccard similarity of two sets, as often as there are answers with them."""
    owner, code, _ = incidence(table.column("phrases"))
    size = np.bincount(owner, minlength=table.num_rows)
    copies = table.column("copies").to_numpy().astype(np.float64)
    common = common_counts(owner, code, table.num_rows, left, right).astype(np.float64)
    union = size[left][:, None] + size[right][None, :] - common
    similar = np.divide(common, union, out=np.zeros_like(common), where=union > 0) * copies[left][:, None] * copies[right][None, :]
    if len(left) == len(right) and (left == right).all():
        similar = np.triu(similar, 1)
    return pa.table([table.column("prompt_id").slice(0, 1), pa.array([similar.sum()])], names=["prompt_id", "similarity"])


def agreement(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """Mean Jaccard similarity over all pairs of answers per prompt, with its level.

    Answers with the same phrases are counted together first, so copies cost nothing: k copies stand for k(k-1)/2 pairs
    of similarity 1.  Different sets meet in tiles of a bounded number of rows, each of which passes on one sum.
    """
    valid = valid_answers(answers)
    n = valid.groupBy("prompt_id").agg(F.count("*").alias("answers"))
    sets = (
        valid.withColumn("phrases", F.array_sort("phrases"))
        .groupBy("prompt_id", "phrases")
        .agg(F.count("*").alias("copies"))
        .withColumns({"set_id": F.xxhash64("phrases"), "size": F.size("phrases")})
    )
    copies = sets.where((F.col("copies") > 1) & (F.col("size") > 0)).select(
        "prompt_id", (F.col("copies") * (F.col("copies") - 1) / 2).alias("similarity")
    )
    prompt = sets.schema["prompt_id"].dataType.simpleString()
    across = in_tiles(sets, ["prompt_id"], "set_id", _similarity, f"prompt_id {prompt}, similarity double")
    total = across.unionByName(copies).groupBy("prompt_id").agg(F.sum("similarity").alias("similarity"))
    joined = prompts.select("prompt_id").join(n, "prompt_id", "left").join(total, "prompt_id", "left")
    count = F.coalesce("answers", F.lit(0))
    pairs = count * (count - 1) / 2
    score = F.coalesce(F.try_divide(F.coalesce("similarity", F.lit(0.0)), pairs), F.lit(0.0))
    level = (
        F.when(count < 2, "insufficient")
        .when(score >= STRONG, "strong")
        .when(score >= PARTIAL, "partial")
        .otherwise("disagreement")
    )
    return joined.select(
        "prompt_id", count.alias("answers"), F.round(score, 4).alias("agreement_score"), level.alias("agreement_level")
    )


def _phrase_counts(answers: DataFrame) -> DataFrame:
    valid = valid_answers(answers)
    n = valid.groupBy("prompt_id").agg(F.count("*").alias("answers")).where(F.col("answers") >= 2)
    words = valid.select("prompt_id", F.explode("phrases").alias("phrase"))
    counted = words.groupBy("prompt_id", "phrase").agg(F.count("*").alias("count"))
    return counted.join(n.select("prompt_id"), "prompt_id", "left_semi")


def common_themes(answers: DataFrame, n: int = 10) -> DataFrame:
    shared = _phrase_counts(answers).where((F.col("count") >= 2) & (F.length("phrase") > 3))
    return ordered.top_rows(shared, ["prompt_id"], [F.desc("count"), F.asc("phrase")], n)


def unique_points(answers: DataFrame, n: int = 10) -> DataFrame:
    alone = _phrase_counts(answers).where((F.col("count") == 1) & (F.length("phrase") > 4)).drop("count")
    return ordered.top_rows(alone, ["prompt_id"], [F.asc("phrase")], n)


def classify_tasks(tasks: DataFrame, keywords: DataFrame) -> DataFrame:
    """tasks(task_id, task) -> class with the most keyword hits (first class on ties) and its share of all hits."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("task"), F.lit("[a-z]+"), F.lit(0)))
    hits = (
        tasks.select("task_id", F.explode(tokens).alias("word"))
        .join(keywords, "word")
        .groupBy("task_id", "task_type", "class_order")
        .agg(F.count("*").alias("hits"))
    )
    best = hits.groupBy("task_id").agg(
        F.max_by("task_type", F.struct(F.col("hits"), -F.col("class_order"))).alias("task_type"),
        F.max("hits").alias("best"),
        F.sum("hits").alias("total"),
    )
    return tasks.select("task_id").join(best, "task_id", "left").select(
        "task_id",
        F.coalesce("task_type", F.lit("general")).alias("task_type"),
        F.coalesce(F.col("best") / F.col("total"), F.lit(NO_CLASS_CONFIDENCE)).alias("confidence"),
    )


def rank_models(classified: DataFrame, scores: DataFrame, available: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Models for every task, best first.  Ranking happens once per class on the small score table, not per task."""
    models = scores.select("model_id").distinct()
    if available is not None:
        models = models.where(F.col("model_id").isin(available))
    pairs = models.withColumn("task_type", F.explode(scores.select(F.collect_set("task_type")).scalar()))
    filled = pairs.join(scores, ["model_id", "task_type"], "left").withColumn("score", F.coalesce("score", F.lit(NO_SCORE)))
    order = [F.desc("score"), F.asc("model_id")]
    ranked = filled.withColumn("rank", F.row_number().over(Window.partitionBy("task_type").orderBy(*order)))
    if n is not None:
        ranked = ranked.where(F.col("rank") <= n)
    return classified.join(ranked, "task_type")
