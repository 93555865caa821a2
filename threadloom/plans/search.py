"""Registered search and recall queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.operators import search as S
from threadloom.operators.index import SearchIndex, result_page
from threadloom.plans.registry import query
from threadloom.plans.summaries import sql_terms
from threadloom.session import saved
from threadloom.sources.testviews import load, table

VIEWS = {
    "v_posts": (
        f"SELECT token, id, count(*) AS tf FROM (SELECT id, unnest({sql_terms('content')}) AS token FROM v_docs)"
        " GROUP BY ALL"
    ),
    "v_lengths": f"SELECT id, CAST(len({sql_terms('content')}) AS INT) AS length FROM v_docs",
    "v_df": "SELECT token, count(*) AS df FROM v_posts GROUP BY 1",
    "v_corpus": "SELECT count(*) AS n, avg(length) AS average FROM v_lengths",
    "v_asked": (
        f"SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({sql_terms('query')}) AS token FROM"
        " v_queries) GROUP BY ALL"
    ),
    "v_bm25": (
        "SELECT * FROM (SELECT query_id, id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 *"
        " (0.25 + 0.75 * length / average))), 6) AS score FROM v_asked JOIN v_posts USING (token) JOIN v_df USING (token)"
        " JOIN v_lengths USING (id), v_corpus GROUP BY query_id, id) WHERE score > 0"
    ),
    "v_vocab": (
        "SELECT token, df, ln((n + 1) / (df + 1)) + 1 AS idf, CAST(row_number() OVER (ORDER BY df DESC, token) - 1 AS INT)"
        " AS dim FROM (SELECT * FROM v_df ORDER BY df DESC, token LIMIT 512), v_corpus"
    ),
    "v_weights": (
        "SELECT id, dim, token, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (SELECT id, dim, token, tf *"
        " idf AS w FROM v_posts JOIN v_vocab USING (token))"
    ),
    "v_qweights": (
        "SELECT query_id, dim, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM (SELECT query_id, dim,"
        " qtf * idf AS w FROM v_asked JOIN v_vocab USING (token))"
    ),
    "v_cosines": (
        "SELECT q.query_id, d.id, coalesce(s.cosine, 0.0) AS cosine FROM v_queries q CROSS JOIN v_docs d LEFT JOIN (SELECT"
        " q.query_id, w.id, sum(q.weight * w.weight) AS cosine FROM v_qweights q JOIN v_weights w USING (dim) GROUP BY"
        " ALL) s ON s.query_id = q.query_id AND s.id = d.id"
    ),
    "v_jaccards": (
        "SELECT a.query_id, p.id, count(*) / CAST(any_value(q.n) + any_value(l.n) - count(*) AS DOUBLE) AS keyword FROM"
        " v_asked a JOIN v_posts p USING (token) JOIN (SELECT query_id, count(*) AS n FROM v_asked GROUP BY 1) q ON"
        " q.query_id = a.query_id JOIN (SELECT id, count(*) AS n FROM v_posts GROUP BY 1) l ON l.id = p.id GROUP BY"
        " a.query_id, p.id"
    ),
    "v_signals": (
        "SELECT c.query_id, c.id, c.cosine, coalesce(j.keyword, 0.0) AS keyword, CASE WHEN d.age_days <= 0 THEN 1.0 ELSE"
        " exp(-ln(2.0) / 30 * d.age_days) END AS recency FROM v_cosines c JOIN v_docs d ON d.id = c.id LEFT JOIN"
        " v_jaccards j ON j.query_id = c.query_id AND j.id = c.id"
    ),
}


def docs(spark, sf_dir):
    return load(spark, sf_dir, "v_docs")


def asked(spark, sf_dir):
    return load(spark, sf_dir, "v_queries")


def index(spark, sf_dir):
    """Postings and lengths, written once so that every later join reads the finished index."""
    d = docs(spark, sf_dir)
    return saved(S.postings(d), "postings"), saved(S.lengths(d), "lengths")


def tfidf(spark, sf_dir):
    """Dense TF-IDF vectors of documents and queries over one vocabulary."""
    posts, sizes = index(spark, sf_dir)
    vocab = saved(S.build_vocabulary(posts, sizes), "vocabulary")
    d = docs(spark, sf_dir)
    doc_vectors = S.dense_vectors(d.select("id"), S.sparse_vectors(posts, vocab))
    q = asked(spark, sf_dir)
    q_docs = q.select(F.col("query_id").alias("id"), F.col("query").alias("content"))
    q_vectors = S.dense_vectors(q_docs.select("id"), S.sparse_vectors(S.postings(q_docs), vocab))
    return d.join(doc_vectors, "id"), q.join(q_vectors.withColumnRenamed("id", "query_id"), "query_id")


@query(
    "index_build", "R1",
    """
SELECT token, count(*) AS df, CAST(sum(tf) AS BIGINT) AS occurrences, max(tf) AS max_tf FROM v_posts GROUP BY 1
""",
    VIEWS,
)
def index_build(spark, sf_dir):
    # An older version of a third of the corpus is indexed first; a second segment replaces it document by document.
    d = docs(spark, sf_dir)
    stale = F.col("age_days") < 30
    old = d.withColumn("content", F.when(stale, F.concat(F.lit("stale "), "content")).otherwise(F.col("content")))
    index = SearchIndex.build(old).apply(d.where(stale))
    counted = index.postings().groupBy("token").agg(F.sum("tf").alias("occurrences"), F.max("tf").alias("max_tf"))
    return index.vocabulary().join(counted, "token")


@query(
    "index_removal", "R2",
    """
SELECT count(*) AS documents, round(avg(length), 6) AS average_length, (SELECT count(*) FROM v_posts JOIN v_docs USING
    (id) WHERE lang <> 'fr') AS postings FROM v_lengths JOIN v_docs USING (id) WHERE lang <> 'fr'
""",
    VIEWS,
)
def index_removal(spark, sf_dir):
    d = docs(spark, sf_dir)
    nothing = d.where(F.lit(False))
    index = SearchIndex.build(d).apply(nothing, d.where("lang = 'fr'").select("id"))
    n, average = index.statistics()
    counted = index.postings().select(F.count("*").alias("postings"))
    return counted.select(F.lit(n).alias("documents"), F.round(F.lit(average), 6).alias("average_length"), "postings")


RENEWED = {
    **VIEWS,
    "v_docs": (
        "SELECT CAST(doc_id AS STRING) AS id, CASE WHEN doc_id % 100 = 0 THEN 'renewed ' || coalesce(text, '') ELSE text END AS content"
        " FROM documents WHERE doc_id % 100 <> 1"
    ),
}


@query(
    "index_upkeep", "R1 R2",
    """
SELECT p.token, df, CAST(sum(tf) AS BIGINT) AS occurrences, (SELECT count(*) FROM v_lengths) AS documents,
    (SELECT round(avg(length), 6) FROM v_lengths) AS average_length FROM v_posts p JOIN v_df f ON f.token = p.token GROUP BY ALL
""",
    RENEWED,
)
def index_upkeep(spark, sf_dir):
    """One document in a hundred is added anew and one removed; the index is merged on read and then compacted."""
    d = docs(spark, sf_dir)
    number = F.col("id").cast("bigint") % 100
    renewed = d.where(number == 0).withColumn("content", F.concat(F.lit("renewed "), F.coalesce("content", F.lit(""))))
    index = SearchIndex.build(d).apply(renewed, d.where(number == 1).select("id")).compact()
    n, average = index.statistics()
    counted = index.postings().groupBy("token").agg(F.sum("tf").alias("occurrences"))
    rows = index.vocabulary().join(counted, "token")
    return rows.withColumns({"documents": F.lit(n), "average_length": F.round(F.lit(average), 6)})


@query("bm25_search", "R3", "SELECT query_id, id, score FROM v_bm25", VIEWS)
def bm25_search(spark, sf_dir):
    return S.bm25(asked(spark, sf_dir), *index(spark, sf_dir))


@query(
    "bm25_filtered", "R4",
    "SELECT query_id, b.id, score FROM v_bm25 b JOIN v_docs d ON d.id = b.id WHERE lang = 'en' AND source IN (SELECT min(source) FROM v_docs)",
    VIEWS,
)
def bm25_filtered(spark, sf_dir):
    d = docs(spark, sf_dir)
    first = d.agg(F.min("source")).first()[0]
    return S.with_metadata(S.bm25(asked(spark, sf_dir), *index(spark, sf_dir)), d, {"lang": "en", "source": first})


@query(
    "bm25_filtered_page", "R4 R5",
    """
SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank,
    count(*) OVER (PARTITION BY query_id) AS total FROM v_bm25 JOIN v_docs USING (id) WHERE lang = 'en'
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10
""",
    VIEWS,
)
def bm25_filtered_page(spark, sf_dir):
    d = docs(spark, sf_dir)
    return result_page(asked(spark, sf_dir), SearchIndex.build(d), 1, 10, d.where("lang = 'en'"))


@query(
    "bm25_page", "R5 R6 T11",
    """
SELECT query_id, id, score, rank, total, CASE WHEN s0 > 0 THEN '...' ELSE '' END || """
    "trim(substr(content, CAST(s0 AS BIGINT) + 1, CAST(e0 - s0 AS BIGINT)), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
    """ || CASE WHEN e0 < length(content) THEN '...' ELSE '' END AS snippet
FROM (SELECT *, greatest(0, p - 50) AS s0, least(length(content), p + 150) AS e0 FROM (
    SELECT r.query_id, r.id, score, rank, total, content, coalesce(list_min(list_filter(list_transform("""
    f"{sql_terms('query')}"
    """, lambda t: instr(lower(content), t)), lambda x: x > 0)) - 1, length(content)) AS p
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank, count(*) OVER
    (PARTITION BY query_id) AS total FROM v_bm25) r JOIN v_docs d ON d.id = r.id JOIN v_queries q ON q.query_id =
    r.query_id WHERE rank > 5 AND rank <= 10))
""",
    VIEWS,
)
def bm25_page(spark, sf_dir):
    q, d = asked(spark, sf_dir), docs(spark, sf_dir)
    return S.with_snippets(result_page(q, SearchIndex.build(d), 2, 5), d, q)


@query("tfidf_vocabulary", "R7", "SELECT token, df, round(idf, 9) AS idf, dim FROM v_vocab", VIEWS)
def tfidf_vocabulary(spark, sf_dir):
    return S.build_vocabulary(*index(spark, sf_dir)).withColumn("idf", F.round("idf", 9))


@query("tfidf_vectors", "R8", "SELECT id, dim, token, round(weight, 9) AS weight FROM v_weights", VIEWS)
def tfidf_vectors(spark, sf_dir):
    posts, sizes = index(spark, sf_dir)
    out = S.sparse_vectors(posts, S.build_vocabulary(posts, sizes))
    return out.withColumn("weight", F.round("weight", 9))


@query(
    "tfidf_top_k", "R9",
    """
SELECT * FROM (SELECT query_id, id, round(cosine, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY
    round(cosine, 6) DESC, id) AS INT) AS rank FROM v_cosines) WHERE rank <= 10
""",
    VIEWS,
)
def tfidf_top_k(spark, sf_dir):
    d, q = tfidf(spark, sf_dir)
    return S.vector_top_k(d, q, 10)


@query(
    "embedding_top_k", "R9 T8",
    """
SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT)
    AS rank FROM (SELECT q.vec_id AS query_id, CAST(e.vec_id AS STRING) AS id,
    round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) /
    (sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) *
    sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])))), 6) AS score
    FROM embeddings q, embeddings e)) WHERE rank <= 10
""",
)
def embedding_top_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return S.vector_top_k(
        e.select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector")),
        e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")),
        10,
    )


@query(
    "session_documents", "R10",
    """
SELECT CAST(session_id AS STRING) AS id, source_llm || ' auto-capture ' || lower(source_llm) AS content FROM v_sessions
WHERE NOT is_archived
""",
)
def session_documents(spark, sf_dir):
    sessions = load(spark, sf_dir, "v_sessions").withColumns(
        {"title": F.col("source_llm"), "tags": F.array(F.lit("auto-capture"), F.lower("source_llm"))}
    )
    return S.session_documents(sessions)


RANKED = (
    "SELECT * FROM (SELECT query_id, id, round({e}, 6) AS score, {extra}round(recency, 6) AS recency_factor,"
    " CAST(row_number() OVER (PARTITION BY query_id ORDER BY round({e}, 6) DESC, id) AS INT) AS rank FROM v_signals"
    " WHERE {e} >= 0.01) WHERE rank <= 20"
)


@query(
    "hybrid_recall", "R11",
    RANKED.format(
        e="((0.4 * keyword + 0.6 * cosine) * recency)",
        extra="round(keyword, 6) AS keyword_score, round(cosine, 6) AS semantic_score, ",
    ),
    VIEWS,
)
def hybrid_recall(spark, sf_dir):
    return S.hybrid_recall(*tfidf(spark, sf_dir))


@query(
    "keyword_recall", "R12", RANKED.format(e="(keyword * recency)", extra="round(keyword, 6) AS keyword_score, "), VIEWS,
)
def keyword_recall(spark, sf_dir):
    return S.keyword_recall(docs(spark, sf_dir), asked(spark, sf_dir))


@query(
    "semantic_recall", "R13",
    RANKED.format(
        e="(cosine * recency)", extra="0.0::DOUBLE AS keyword_score, round(cosine, 6) AS semantic_score, "
    ),
    VIEWS,
)
def semantic_recall(spark, sf_dir):
    return S.semantic_recall(*tfidf(spark, sf_dir))
