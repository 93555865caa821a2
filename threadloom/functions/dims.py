"""Small dimension tables made from the fixed values (a few dozen rows each, so broadcasting them is safe)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import fixed


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.TIERS, fixed.TIER_COLUMNS)


def policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.POLICIES, fixed.POLICY_COLUMNS)


def subscription_policies(spark: SparkSession) -> DataFrame:
    rows = list(fixed.SUBSCRIPTION_POLICY.items())
    return spark.createDataFrame(rows, "tier string, policy string")


def call_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.CALL_PRICES, "model_id string, prompt_price double, completion_price double")


def model_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fixed.MODEL_REGISTRY,
        "model_id string, provider string, prompt_price double, completion_price double, max_context int",
    )


def task_keywords(spark: SparkSession) -> DataFrame:
    rows = [(w, c, i) for i, (c, ws) in enumerate(fixed.TASK_KEYWORDS) for w in ws.split()]
    return spark.createDataFrame(rows, "word string, task_type string, class_order int")


def model_scores(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.MODEL_SCORES, "model_id string, task_type string, score double")


def technology_terms(spark: SparkSession) -> DataFrame:
    pairs = [line.split(" = ") for line in fixed.TECHNOLOGY_TERMS.strip().splitlines()]
    rows = [(term, canonical, "tech", i) for i, (term, canonical) in enumerate(pairs)]
    return spark.createDataFrame(rows, "term string, canonical string, type string, place int")


def opposing_words() -> list[tuple[str, str]]:
    """Both directions of every opposing pair as (word, opposing word)."""
    rows = []
    for left, right in fixed.OPPOSING_CHOICES:
        rows += [(a, b) for a in left for b in right] + [(b, a) for a in left for b in right]
    return sorted(set(rows))


def type_weight(column):
    branch = None
    for name, weight in fixed.TYPE_WEIGHTS.items():
        branch = F.when(F.col(column) == name, weight) if branch is None else branch.when(F.col(column) == name, weight)
    return branch.otherwise(0.3)
