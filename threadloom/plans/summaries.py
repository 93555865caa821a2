"""Registered text, topic and summary queries over the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import fixed
from threadloom.functions import text as T
from threadloom.operators import summaries as S
from threadloom.plans.registry import query
from threadloom.sources.testviews import load, table

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
STOP = "[" + ", ".join(f"'{w}'" for w in fixed.SUMMARY_STOP_WORDS) + "]"
AGREE_STOP = "[" + ", ".join(f"'{w}'" for w in fixed.AGREEMENT_STOP_WORDS) + "]"


def sql_strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def sql_words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-zA-Z0-9_]+')"


def sql_terms(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def sql_sentences(x: str) -> str:
    cut = f"string_split(regexp_replace({sql_strip(x)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {sql_strip('s')}), lambda s: s <> '')"


SQL_KEYWORDS = (
    f"list_distinct(list_filter({sql_words('full_text')}, lambda t: length(t) > 2 AND NOT list_contains({STOP}, t)))"
)

SQL_JACCARD = (
    "CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN {e} WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE"
    " len(list_intersect({a}, {b})) / CAST(len({a}) + len({b}) - len(list_intersect({a}, {b})) AS DOUBLE) END"
)


def sql_jaccard(a: str, b: str, both_empty: str = "0.0") -> str:
    return SQL_JACCARD.format(a=a, b=b, e=both_empty)


def scored_view(source: str, scope: str) -> str:
    """Sentence scores within a scope as SQL; `source` has conv_id, turn, pos, sentence, n_words, content, ..."""
    on = " AND ".join(f"{{0}}.{c} = {{1}}.{c}" for c in scope.split(", "))
    return (
        f"SELECT s.*, round(coalesce(w.score, 0.0), 6) AS score FROM {source} s LEFT JOIN ("
        f"SELECT o.conv_id, o.turn, o.pos, sum(ln((n.n + 1) / (d.df + 1)) + 1) / any_value(o.n_words) AS score"
        f" FROM (SELECT {scope}, conv_id AS c0, turn, pos, n_words, unnest(content) AS token FROM {source}) o"
        f" JOIN (SELECT {scope}, token, count(*) AS df FROM (SELECT {scope}, unnest(list_distinct(content)) AS token"
        f" FROM {source}) GROUP BY ALL) d ON {on.format('o', 'd')} AND o.token = d.token"
        f" JOIN (SELECT {scope}, count(*) AS n FROM {source} GROUP BY ALL) n ON {on.format('o', 'n')}"
        f" GROUP BY o.conv_id, o.turn, o.pos) w ON w.conv_id = s.conv_id AND w.turn = s.turn AND w.pos = s.pos"
    )


def sentence_view(source: str, extra: str = "") -> str:
    return (
        f"SELECT * EXCLUDE (toks), len(toks) AS n_words, list_filter(toks, lambda t: NOT list_contains({STOP}, t)) AS"
        f" content FROM (SELECT *, {sql_words('sentence')} AS toks FROM (SELECT conv_id, turn{extra},"
        f" generate_subscripts(ss, 1) - 1 AS pos, unnest(ss) AS sentence FROM (SELECT *,"
        f" {sql_sentences('full_text')} AS ss FROM {source})))"
    )


VIEWS = {
    "v_sentences": sentence_view("v_messages"),
    "v_scored": scored_view("v_sentences", "conv_id"),
    "v_keywords": f"SELECT *, {SQL_KEYWORDS} AS keywords FROM v_messages",
    "v_segments": (
        "SELECT *, CAST(sum(starts) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS segment FROM (SELECT *,"
        f" CASE WHEN prev IS NOT NULL AND {sql_jaccard('prev', 'keywords', '1.0')} >= 0.15 THEN 0 ELSE 1 END AS starts"
        " FROM (SELECT *, lag(keywords) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM v_keywords))"
    ),
    "v_topics": "SELECT *, segment AS topic, TRUE AS is_core FROM v_segments",
    "v_topics2": (
        "SELECT s.*, k.topic, k.is_core FROM v_segments s JOIN (SELECT conv_id, segment, kept = 1 AS is_core,"
        " CAST(sum(kept) OVER (PARTITION BY conv_id ORDER BY segment) - 1 AS BIGINT) AS topic FROM (SELECT conv_id,"
        " segment, CASE WHEN count(*) >= 2 OR segment = 0 THEN 1 ELSE 0 END AS kept FROM v_segments GROUP BY 1, 2)) k"
        " ON k.conv_id = s.conv_id AND k.segment = s.segment"
    ),
    "v_topic_sentences": sentence_view("v_topics", ", topic"),
    "v_topic_scored": scored_view("v_topic_sentences", "conv_id, topic"),
    "v_message_summaries": (
        "SELECT conv_id, 'message' AS level, content, CAST(len(regexp_extract_all(lower(content),"
        " '[a-zA-Z0-9_]+')) AS INT) AS token_count, turn AS first_turn, turn AS last_turn FROM (SELECT m.conv_id, m.turn,"
        f" CASE WHEN length({sql_strip('full_text')}) <= 50 THEN {sql_strip('full_text')} ELSE coalesce(b.sentence,"
        f" substr({sql_strip('full_text')}, 1, 200)) END AS content FROM v_messages m LEFT JOIN (SELECT * FROM v_scored"
        " QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, pos) = 1) b ON b.conv_id ="
        f" m.conv_id AND b.turn = m.turn WHERE {sql_strip('full_text')} <> '')"
    ),
    "v_topic_summaries": (
        "SELECT *, CAST(len(regexp_extract_all(lower(content), '[a-zA-Z0-9_]+')) AS INT) AS token_count FROM (SELECT"
        " r.conv_id, r.topic, 'topic' AS level, string_agg(sentence, ' ' ORDER BY rk) AS content, any_value(lo) AS"
        " first_turn, any_value(hi) AS last_turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, topic ORDER BY"
        " score DESC, turn, pos) AS rk FROM v_topic_scored) r JOIN (SELECT conv_id, topic, min(turn) AS lo, max(turn)"
        " AS hi FROM v_topics GROUP BY 1, 2) x ON x.conv_id = r.conv_id AND x.topic = r.topic WHERE rk <= 5"
        " GROUP BY r.conv_id, r.topic)"
    ),
    "v_global_rows": (
        "SELECT * FROM (SELECT *, sum(n_words) OVER (PARTITION BY conv_id ORDER BY rk) AS words_so_far FROM (SELECT *,"
        " row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn, pos) AS rk FROM v_scored) WHERE rk <= 10)"
        " WHERE words_so_far <= 200 OR rk = 1"
    ),
    "v_global_summaries": (
        "SELECT g.conv_id, 'global' AS level, content, CAST(len(regexp_extract_all(lower(content), '[a-zA-Z0-9_]+')) AS"
        " INT) AS token_count, CAST(0 AS BIGINT) AS first_turn, n - 1 AS last_turn FROM (SELECT conv_id,"
        " string_agg(sentence, ' ' ORDER BY rk) AS content FROM v_global_rows GROUP BY 1) g JOIN (SELECT conv_id,"
        " count(*) AS n FROM v_messages GROUP BY 1) m ON m.conv_id = g.conv_id"
    ),
    "v_summaries": (
        "SELECT conv_id, level, content, token_count, first_turn, last_turn FROM v_message_summaries UNION ALL"
        " SELECT conv_id, level, content, token_count, first_turn, last_turn FROM v_topic_summaries UNION ALL"
        " SELECT conv_id, level, content, token_count, first_turn, last_turn FROM v_global_summaries"
    ),
}


def messages(spark, sf_dir):
    return load(spark, sf_dir, "v_messages")


@query(
    "word_tokens", "T1 T5",
    f"""
SELECT conv_id, turn, CAST(len(w) AS INT) AS n_words, array_to_string(w, ' ') AS words,
    array_to_string(list_filter(w, lambda t: NOT list_contains({STOP}, t)), ' ') AS content_words
FROM (SELECT conv_id, turn, {sql_words('full_text')} AS w FROM v_messages)
""",
)
def word_tokens(spark, sf_dir):
    tokens = messages(spark, sf_dir).select("conv_id", "turn", T.words("full_text").alias("w"))
    return tokens.select(
        "conv_id", "turn", F.size("w").alias("n_words"), F.array_join("w", " ").alias("words"),
        F.array_join(T.content_words(F.col("w")), " ").alias("content_words"),
    )


@query(
    "search_tokens", "T2",
    f"""
SELECT doc_id, CAST(len(t) AS INT) AS n_terms, CAST(len(list_distinct(t)) AS INT) AS n_distinct,
    md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {sql_terms('text')} AS t FROM documents)
""",
)
def search_tokens(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", T.terms("text").alias("t"))
    return tokens.select(
        "doc_id", F.size("t").alias("n_terms"), F.size(F.array_distinct("t")).alias("n_distinct"),
        F.md5(F.array_join("t", " ").cast("binary")).alias("digest"),
    )


@query(
    "key_phrases", "T3",
    f"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(full_text),
    '[a-z]{{3,}}'), lambda t: NOT list_contains({AGREE_STOP}, t)))), ' ') AS phrases FROM v_messages
""",
)
def key_phrases(spark, sf_dir):
    return messages(spark, sf_dir).select(
        "conv_id", "turn", F.array_join(F.array_sort(T.phrases("full_text")), " ").alias("phrases")
    )


@query("sentence_split", "T4", "SELECT conv_id, turn, CAST(pos AS INT) AS pos, sentence FROM v_sentences", VIEWS)
def sentence_split(spark, sf_dir):
    return S.sentence_table(messages(spark, sf_dir)).select("conv_id", "turn", "pos", "sentence")


@query(
    "message_text_costs", "T7 T12",
    f"""
SELECT conv_id, turn, CAST(CASE WHEN length(full_text) = 0 THEN 0 ELSE greatest(1, length(full_text) // 4) END AS INT)
    AS tokens, {sql_strip('lower(full_text)')} AS name_key FROM v_messages
""",
)
def message_text_costs(spark, sf_dir):
    return messages(spark, sf_dir).select(
        "conv_id", "turn", T.token_estimate(F.col("full_text")).alias("tokens"),
        T.name_key(F.col("full_text")).alias("name_key"),
    )


@query(
    "adjacent_similarity", "T6",
    f"""
SELECT conv_id, turn, round({sql_jaccard('prev', 'keywords', '1.0')}, 9) AS similarity FROM (SELECT *, lag(keywords)
    OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM v_keywords) WHERE prev IS NOT NULL
""",
    VIEWS,
)
def adjacent_similarity(spark, sf_dir):
    from threadloom.functions import ordered

    marked = messages(spark, sf_dir).withColumn("keywords", T.keywords("full_text"))
    bucket = ordered.bucket_of("turn", S.TURN_BUCKET)
    paired = ordered.previous(marked, ["conv_id"], ["turn"], ["keywords"], bucket, "before")
    similarity = T.jaccard(F.col("before.keywords"), F.col("keywords"), both_empty=1.0)
    return paired.where("before IS NOT NULL").select("conv_id", "turn", F.round(similarity, 9).alias("similarity"))


@query(
    "artifact_truncation", "T13",
    """
SELECT doc_id, md5(CASE WHEN nl - 1 > 200 THEN substr(head, 1, nl - 1) ELSE head END || chr(10) || '... [truncated]') AS
    digest FROM (SELECT doc_id, head, CASE WHEN contains(head, chr(10)) THEN length(head) - instr(reverse(head), chr(10))
    + 1 ELSE 0 END AS nl FROM (SELECT doc_id, substr(text, 1, 400) AS head FROM documents WHERE length(text) > 400))
""",
)
def artifact_truncation(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 400)
    return docs.select("doc_id", F.md5(T.truncate_artifact(F.col("text"), 100).cast("binary")).alias("digest"))


@query(
    "message_identity", "T14",
    "SELECT conv_id, turn, sha256(role || ':' || turn || ':' || substr(full_text, 1, 200)) AS identity FROM v_messages",
)
def message_identity(spark, sf_dir):
    return messages(spark, sf_dir).select(
        "conv_id", "turn", T.message_identity(F.col("role"), F.col("turn"), F.col("full_text")).alias("identity")
    )


@query(
    "conversation_identity", "T15",
    """
SELECT page_id, regexp_replace(url, '[?#].*$', '') AS clean_url, 'chatgpt:' || substr(sha256(regexp_replace(url,
    '[?#].*$', '')), 1, 16) AS conversation_key FROM pages
""",
)
def conversation_identity(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", T.conversation_url(F.col("url")).alias("clean_url"),
        T.conversation_identity(F.lit("chatgpt"), F.col("url")).alias("conversation_key"),
    )


@query(
    "blank_cleanup", "T16",
    f"""
SELECT page_id, md5({sql_strip("regexp_replace(regexp_replace(html, chr(10) || '{3,}', chr(10) || chr(10), 'g'), '[ ' || chr(9) || ']+', ' ', 'g')")}) AS
    digest FROM pages
""",
)
def blank_cleanup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.md5(T.squeeze_blanks(F.col("html")).cast("binary")).alias("digest"))


@query(
    "session_age_and_recency", "T9 T10",
    """
SELECT session_id, round(age, 6) AS age_days, round(CASE WHEN age <= 0 THEN 1.0 ELSE exp(-ln(2.0) / 30 * age) END, 9) AS
    recency FROM (SELECT session_id, greatest(0.0, date_diff('microsecond', created_at, TIMESTAMP '1998-01-01 12:00:00')
    / 86400000000.0) AS age FROM v_sessions)
""",
)
def session_age_and_recency(spark, sf_dir):
    now = F.lit("1998-01-01 12:00:00").cast("timestamp")
    aged = load(spark, sf_dir, "v_sessions").withColumn(
        "age", T.age_days(now, F.col("created_at").cast("timestamp"))
    )
    return aged.select(
        "session_id", F.round("age", 6).alias("age_days"), F.round(T.recency(F.col("age"), 30), 9).alias("recency")
    )


@query(
    "sentence_idf", "M1",
    """
SELECT conv_id, token, df, round(ln((n + 1) / (df + 1)) + 1, 9) AS idf FROM (SELECT conv_id, token, count(*) AS df FROM
    (SELECT conv_id, unnest(list_distinct(content)) AS token FROM v_sentences) GROUP BY 1, 2)
JOIN (SELECT conv_id, count(*) AS n FROM v_sentences GROUP BY 1) USING (conv_id)
""",
    VIEWS,
)
def sentence_idf(spark, sf_dir):
    idf = S.sentence_idf(S.sentence_table(messages(spark, sf_dir)))
    return idf.withColumn("idf", F.round("idf", 9))


@query(
    "sentence_scores", "M2", "SELECT conv_id, turn, CAST(pos AS INT) AS pos, score FROM v_scored", VIEWS,
)
def sentence_scores(spark, sf_dir):
    return S.score_sentences(S.sentence_table(messages(spark, sf_dir))).select("conv_id", "turn", "pos", "score")


@query("message_summaries", "M3", "SELECT * FROM v_message_summaries", VIEWS)
def message_summaries(spark, sf_dir):
    m = messages(spark, sf_dir)
    return S.message_summaries(m, S.score_sentences(S.sentence_table(m)))


@query("topic_segments", "M4", "SELECT conv_id, turn, segment FROM v_segments", VIEWS)
def topic_segments(spark, sf_dir):
    return S.segment_topics(messages(spark, sf_dir)).select("conv_id", "turn", "segment")


@query("topic_merge", "M5", "SELECT conv_id, turn, segment, topic, is_core FROM v_topics2", VIEWS)
def topic_merge(spark, sf_dir):
    merged = S.merge_small_segments(S.segment_topics(messages(spark, sf_dir)), 2)
    return merged.select("conv_id", "turn", "segment", "topic", "is_core")


@query(
    "topic_labels", "M6",
    """
WITH c AS (SELECT conv_id, topic, word, count(*) AS n FROM (SELECT conv_id, topic, unnest(keywords) AS word FROM
    v_topics2 WHERE is_core) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, topic ORDER BY n DESC, word) AS rk FROM c),
l AS (SELECT conv_id, topic, string_agg(word, ', ' ORDER BY rk) AS label FROM r WHERE rk <= 3 GROUP BY ALL)
SELECT t.*, coalesce(label, 'General') AS label FROM (SELECT conv_id, topic, count(*) AS messages, min(turn) AS
    first_turn, max(turn) AS last_turn FROM v_topics2 GROUP BY ALL) t LEFT JOIN l ON l.conv_id = t.conv_id AND l.topic =
    t.topic
""",
    VIEWS,
)
def topic_labels(spark, sf_dir):
    return S.topic_labels(S.merge_small_segments(S.segment_topics(messages(spark, sf_dir)), 2))


@query("topic_summaries", "M7", "SELECT * FROM v_topic_summaries", VIEWS)
def topic_summaries(spark, sf_dir):
    return S.topic_summaries(S.merge_small_segments(S.segment_topics(messages(spark, sf_dir))))


@query("global_summaries", "M8", "SELECT * FROM v_global_summaries", VIEWS)
def global_summaries(spark, sf_dir):
    m = messages(spark, sf_dir)
    return S.global_summaries(m, S.score_sentences(S.sentence_table(m)))


@query(
    "summary_stats", "M9",
    """
SELECT conv_id, CAST(count_if(level = 'message') AS BIGINT) AS message_summaries, CAST(count_if(level = 'topic') AS
    BIGINT) AS topic_summaries, CAST(count_if(level = 'global') AS BIGINT) AS global_summaries, CAST(sum(token_count) AS
    BIGINT) AS summary_tokens FROM v_summaries GROUP BY 1
""",
    VIEWS,
)
def summary_stats(spark, sf_dir):
    return S.summary_stats(S.all_summaries(messages(spark, sf_dir)))
