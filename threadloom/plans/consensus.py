"""Registered agreement and dispatch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import dims, fixed
from threadloom.operators import consensus as C
from threadloom.plans.registry import query
from threadloom.plans.reports import values
from threadloom.plans.summaries import AGREE_STOP
from threadloom.sources.testviews import load

PLANTED = [
    (0, " fix the bug and write a test"),
    (1, " write a story, a poem"),
    (2, " compare performance metrics of the api"),
    (3, " explain how and why"),
]
PLANT_SQL = "full_text || CASE conv_id % 6 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PLANTED) + " ELSE '' END"
KEYWORDS = [(w, c, i) for i, (c, ws) in enumerate(fixed.TASK_KEYWORDS) for w in ws.split()]

VIEWS = {
    "v_phrases": (
        "SELECT prompt_id, answer_id, list_distinct(list_filter(regexp_extract_all(lower(content), '[a-z]{3,}'), lambda t: NOT"
        f" list_contains({AGREE_STOP}, t))) AS ph FROM v_answers WHERE trim(content) <> ''"
    ),
    "v_sizes": "SELECT prompt_id, count(*) AS n FROM v_phrases GROUP BY 1",
    "v_phrase_counts": (
        "SELECT c.* FROM (SELECT prompt_id, phrase, count(*) AS count FROM (SELECT prompt_id, unnest(ph) AS phrase FROM"
        " v_phrases) GROUP BY ALL) c JOIN v_sizes s ON s.prompt_id = c.prompt_id WHERE s.n >= 2"
    ),
    "v_keywords_of": f"SELECT * FROM (VALUES {values(KEYWORDS)}) AS t(word, task_type, class_order)",
    "v_scores_of": f"SELECT * FROM (VALUES {values(fixed.MODEL_SCORES)}) AS t(model_id, task_type, score)",
    "v_work": f"SELECT conv_id || ':' || turn AS task_id, {PLANT_SQL} AS task FROM v_messages",
    "v_class_hits": (
        "SELECT task_id, task_type, class_order, count(*) AS hits FROM (SELECT task_id,"
        " unnest(list_distinct(regexp_extract_all(lower(task), '[a-z]+'))) AS word FROM v_work) JOIN v_keywords_of USING (word)"
        " GROUP BY ALL"
    ),
    "v_classified": (
        "SELECT w.task_id, coalesce(b.task_type, 'general') AS task_type, coalesce(b.hits / b.total, CAST(0.3 AS DOUBLE)) AS"
        " confidence FROM v_work w LEFT JOIN (SELECT *, sum(hits) OVER (PARTITION BY task_id) AS total FROM v_class_hits QUALIFY"
        " row_number() OVER (PARTITION BY task_id ORDER BY hits DESC, class_order) = 1) b USING (task_id)"
    ),
}


def answers(spark, sf_dir):
    return load(spark, sf_dir, "v_answers").withColumn("error", F.lit(False))


@query(
    "answer_agreement", "A29",
    """
SELECT c.conv_id AS prompt_id, coalesce(s.n, 0) AS answers, round(coalesce(j.m, 0.0), 4) AS agreement_score, CASE WHEN
    coalesce(s.n, 0) < 2 THEN 'insufficient' WHEN j.m >= 0.4 THEN 'strong' WHEN j.m >= 0.2 THEN 'partial' ELSE 'disagreement'
    END AS agreement_level FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN v_sizes s ON s.prompt_id = c.conv_id
LEFT JOIN (SELECT a.prompt_id, avg(CASE WHEN len(a.ph) = 0 OR len(b.ph) = 0 THEN 0.0 ELSE len(list_intersect(a.ph, b.ph)) /
    CAST(len(a.ph) + len(b.ph) - len(list_intersect(a.ph, b.ph)) AS DOUBLE) END) AS m FROM v_phrases a JOIN v_phrases b ON
    a.prompt_id = b.prompt_id AND a.answer_id < b.answer_id GROUP BY 1) j ON j.prompt_id = c.conv_id
""",
    VIEWS,
)
def answer_agreement(spark, sf_dir):
    prompts = load(spark, sf_dir, "v_messages").select(F.col("conv_id").alias("prompt_id")).distinct()
    return C.agreement(prompts, answers(spark, sf_dir))


@query(
    "common_themes", "A30",
    """
SELECT prompt_id, phrase, count, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY count DESC, phrase) AS INT) AS rank
FROM v_phrase_counts WHERE count >= 2 AND length(phrase) > 3 QUALIFY rank <= 10
""",
    VIEWS,
)
def common_themes(spark, sf_dir):
    return C.common_themes(answers(spark, sf_dir))


@query(
    "unique_points", "A31",
    """
SELECT prompt_id, phrase, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY phrase) AS INT) AS rank FROM v_phrase_counts
WHERE count = 1 AND length(phrase) > 4 QUALIFY rank <= 10
""",
    VIEWS,
)
def unique_points(spark, sf_dir):
    return C.unique_points(answers(spark, sf_dir))


def work(spark, sf_dir):
    m = load(spark, sf_dir, "v_messages")
    extra = None
    for k, v in PLANTED:
        hit = F.col("conv_id") % 6 == k
        extra = F.when(hit, v) if extra is None else extra.when(hit, v)
    task = F.concat("full_text", extra.otherwise(""))
    return m.select(F.concat_ws(":", "conv_id", "turn").alias("task_id"), task.alias("task"))


@query(
    "task_classification", "A32", "SELECT task_id, task_type, round(confidence, 6) AS confidence FROM v_classified", VIEWS,
)
def task_classification(spark, sf_dir):
    out = C.classify_tasks(work(spark, sf_dir), dims.task_keywords(spark))
    return out.withColumn("confidence", F.round("confidence", 6))


@query(
    "model_ranking", "A33",
    """
SELECT c.task_id, c.task_type, round(c.confidence, 6) AS confidence, r.model_id, CAST(r.score AS DOUBLE) AS score, r.rank FROM
    v_classified c JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY task_type ORDER BY score DESC, model_id) AS INT) AS rank
    FROM v_scores_of WHERE model_id <> 'openai/gpt-4o') r ON r.task_type = c.task_type WHERE r.rank <= 2
""",
    VIEWS,
)
def model_ranking(spark, sf_dir):
    classified = C.classify_tasks(work(spark, sf_dir), dims.task_keywords(spark))
    names = sorted({m for m, _, _ in fixed.MODEL_SCORES} - {"openai/gpt-4o"})
    out = C.rank_models(classified, dims.model_scores(spark), names, 2)
    return out.withColumn("confidence", F.round("confidence", 6))
