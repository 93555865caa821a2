"""Inverted index, BM25, TF-IDF vectors, vector search and hybrid recall for batches of queries.

The index is three tables: postings(token, id, length, tf), lengths(id, length) and vocabulary(token, df).  They are ordinary
DataFrames: build them once, write them, and join any number of query batches to them.

Scoring of vectors is brute force by definition (every document gets a score).  Documents and queries are written once in blocks
and all pairs of blocks meet without a shuffle (functions/blocks.py): a task streams documents past a block of queries and keeps
the best k of each.  Nothing travels through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import blocks, ordered
from threadloom.functions import text as T
from threadloom.functions.barrier import once
from threadloom.functions.blocks import Pairs
from threadloom.functions.copies import by_repetition, value_counts
from threadloom.session import saved

K1 = 1.5
B = 0.75
VOCABULARY_SIZE = 512
KEYWORD_WEIGHT = 0.4
SEMANTIC_WEIGHT = 0.6
RECALL_HALF_LIFE = 30.0
RECALL_MIN_SCORE = 0.01
RECALL_RESULTS = 20
#: Queries and documents of a block at most, and documents and scores that are worked on at once.
QUERY_BLOCK = 4096
TILE_DOCUMENTS = 4096
SLICE_ROWS = 1024
SLICE_SCORES = 1 << 20
#: What tiles found is merged when a query has got so many rows on average beyond its best k.
MERGED = 256
#: The asked tokens of a batch of queries are sent to all tasks up to this number; beyond it their joins shuffle.
SENT_TOKENS = 200_000


# -- index -----------------------------------------------------------------------------------------------------------


def latest_documents(batches: DataFrame, version: str = "version") -> DataFrame:
    """The last write per document id wins."""
    rest = [c for c in batches.columns if c not in ("id", version)]
    newest = batches.groupBy("id").agg(F.max_by(F.struct(*rest), version).alias("doc"))
    return newest.select("id", "doc.*")


def postings(docs: DataFrame, *carried: str) -> DataFrame:
    """Term frequency per (token, id), with the document's length so that scoring needs no second join.

    Occurrences are counted in the row that holds them; only documents whose id comes again are shuffled.  `carried` columns
    go along and tell the rows of an id apart; with any of them, a document without tokens keeps one row of a null token and
    length 0.
    """
    tokens = F.coalesce(T.terms("content"), F.array().cast("array<string>"))
    own, copies = (docs, None) if carried else by_repetition(docs.select("id", "content"), "id")
    found = once(own.select("id", *carried, "content"), s=tokens).select("id", *carried, F.size("s").alias("length"), "s")
    each = F.inline_outer("s") if carried else F.inline("s")
    posts = value_counts(found, "s").select("id", *carried, "length", each)
    posts = posts.select(F.col("value").alias("token"), "id", *carried, "length", F.coalesce("n", F.lit(0)).cast("bigint").alias("tf"))
    if copies is None:
        return posts
    rows = once(copies, s=tokens).select("id", F.size("s").alias("length"), F.explode("s").alias("token"))
    return posts.unionByName(rows.groupBy("token", "id", "length").agg(F.count("*").alias("tf")))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.size(T.terms("content")).alias("length"))


def vocabulary(posts: DataFrame) -> DataFrame:
    return posts.groupBy("token").agg(F.count("*").alias("df"))


def remove_documents(posts: DataFrame, sizes: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index without some ids; average length and document frequency follow from the reduced tables."""
    return posts.join(removed, "id", "left_anti"), sizes.join(removed, "id", "left_anti")


# -- BM25 ------------------------------------------------------------------------------------------------------------


def asked_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, token, qtf): how often each query asks for a token."""
    tokens = queries.select("query_id", F.explode(T.terms("query")).alias("token"))
    return tokens.groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def bm25(queries: DataFrame, posts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Score of every document that shares a token with a query; a repeated query token counts again."""
    asked = saved(asked_tokens(queries), "asked")
    few = asked.count() <= SENT_TOKENS

    def sent(rows: DataFrame) -> DataFrame:
        return F.broadcast(rows) if few else rows

    # Only the postings of asked tokens go on; document frequency is computed on them, so rare-token statistics of the
    # rest of the vocabulary are never aggregated.
    wanted = posts.join(sent(asked.select("token").distinct()), "token", "left_semi")
    n = sizes.select(F.count("*")).scalar()
    average = sizes.select(F.avg("length")).scalar()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weighted = asked.join(vocabulary(wanted), "token").select("query_id", "token", (idf * F.col("qtf")).alias("weight"))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("length") / average)
    impact = wanted.select("id", "token", (F.col("tf") * (K1 + 1) / norm).alias("impact"))
    if few:
        # The postings of a document meet before they are joined, so its scores are added up where they arise.
        impact = impact.repartition("id")
    return (
        impact.join(sent(weighted), "token")
        .groupBy("query_id", "id")
        .agg(F.round(F.sum(F.col("weight") * F.col("impact")), 6).alias("score"))
        .where(F.col("score") > 0)
    )


def with_metadata(hits: DataFrame, docs: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Hits whose document has every given value; the statistics behind the scores are left alone."""
    condition = F.lit(True)
    for key, value in filters.items():
        condition = condition & (F.col(key) == value)
    return hits.join(docs.where(condition).select("id"), "id", "left_semi")


def result_page(hits: DataFrame, page: int, page_size: int) -> DataFrame:
    """One page per query with the total before paging; ties by document id."""
    totals = hits.groupBy("query_id").agg(F.count("*").alias("total"))
    order = [F.desc("score"), F.asc("id")]
    top = ordered.top_rows(hits, ["query_id"], order, page * page_size).where(F.col("rank") > (page - 1) * page_size)
    return top.join(totals, "query_id")


def with_snippets(rows: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Snippets for the rows of a page only."""
    asked = queries.select("query_id", T.terms("query").alias("__tokens"))
    joined = rows.join(docs.select("id", "content"), "id").join(asked, "query_id")
    return joined.withColumn("snippet", T.snippet(F.col("content"), F.col("__tokens"))).drop("content", "__tokens")


# -- TF-IDF vectors ----------------------------------------------------------------------------------------------------


def build_vocabulary(posts: DataFrame, sizes: DataFrame, max_terms: int = VOCABULARY_SIZE) -> DataFrame:
    """The most frequent terms by document frequency (ties by term) with their idf and dimension number."""
    n = sizes.select(F.count("*")).scalar()
    top = vocabulary(posts).orderBy(F.desc("df"), F.asc("token")).limit(max_terms)
    placed = ordered.top_rows(top.withColumn("__all", F.lit(1)), ["__all"], [F.desc("df"), F.asc("token")], max_terms, "dim")
    return placed.select(
        "token", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"), (F.col("dim") - 1).alias("dim")
    )


def sparse_vectors(posts: DataFrame, vocab: DataFrame) -> DataFrame:
    """L2-normalized weights (id, dim, token, weight).  The vocabulary has at most `max_terms` rows: broadcast."""
    raw = posts.join(F.broadcast(vocab), "token").withColumn("w", F.col("tf") * F.col("idf"))
    norms = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "id").select("id", "dim", "token", (F.col("w") / F.col("norm")).alias("weight"))


def dense_vectors(ids: DataFrame, sparse: DataFrame, size: int = VOCABULARY_SIZE) -> DataFrame:
    """id -> array of `size` numbers; documents without any vocabulary term get the zero vector."""
    entries = sparse.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "weight"))).alias("m"))
    vector = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), F.lit(0.0))
    )
    zeros = F.array_repeat(F.lit(0.0), size)
    return ids.join(entries, "id", "left").select("id", F.when(F.col("m").isNull(), zeros).otherwise(vector).alias("vector"))


# -- scoring of documents against blocks of queries ----------------------------------------------------------------------


def _matrix(column, dim: int) -> np.ndarray:
    """The vectors of `dim` numbers in an Arrow list column as rows scaled to length 1; other rows are zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    usable = (sizes == dim) & (dim > 0)
    rows = np.zeros((len(sizes), dim))
    if usable.any():
        flat = column.filter(pa.array(usable)).flatten().to_numpy(zero_copy_only=False)
        rows[usable] = np.asarray(flat, dtype=np.float64).reshape(-1, dim)
    norms = np.sqrt((rows * rows).sum(axis=1))
    return rows / np.where(norms > 0, norms, 1.0)[:, None]


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero as in Spark SQL (numpy would round them to even)."""
    return np.sign(x) * np.floor(np.abs(x) * 1e6 + 0.5) / 1e6 + 0.0


def _nearby(part: pa.Table, recency: np.ndarray, block: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, queries and similarity of the pairs that may be among the best k by similarity times recency.

    Products in short numbers exclude most pairs; their error is below `margin`, because vectors have length 1.
    """
    shape = part.num_rows, len(block["ids"])
    near = np.zeros(shape, np.float32) if [len(places) for places, _, _ in block["by_length"]] != [shape[1]] else None
    units, margin = {}, 2e-6
    for places, unit, short in block["by_length"]:
        dim = unit.shape[1]
        units[dim] = _matrix(part.column("vector"), dim)
        product = units[dim].astype(np.float32) @ short.T
        if near is None:
            near = product
        else:
            near[:, places] = product
        margin = max(margin, 2e-6 + 2.0**-22 * (dim + 8))
    if (recency != 1).any():
        near *= recency[:, None].astype(np.float32)
    if not block["seen"] and part.num_rows >= k:
        reached = np.partition(np.where(np.isnan(near), np.float32(-np.inf), near), part.num_rows - k, axis=0)[part.num_rows - k]
        block["floor"] = np.maximum(block["floor"], _rounded(reached.astype(np.float64) - margin))
    block["seen"] = True
    # Flat, because numpy looks through one dimension much faster than through two.
    rows, cols = np.divmod(np.flatnonzero(near >= (block["floor"] - margin).astype(np.float32)), shape[1])
    exact = np.zeros(len(rows))
    for places, unit, _ in block["by_length"]:
        at = np.full(len(block["ids"]), -1)
        at[places] = np.arange(len(places))
        mine = np.flatnonzero(at[cols] >= 0)
        for some in np.array_split(mine, -(-len(mine) * unit.shape[1] // SLICE_SCORES) or 1):
            exact[some] = np.einsum("ij,ij->i", units[unit.shape[1]][rows[some]], unit[at[cols[some]]])
    return rows, cols, exact


def _best_of(docs: pa.Table, block: dict, mode: str, k: int, minimum: float | None, half_life: float) -> Iterator[pa.Table]:
    """Score documents against one block of queries; rows that may be among the best k, by the query's place in the block."""
    has_query_vector = block["has_vector"]
    # The scores of a slice stay at some 8 MB, its token matrix at some 32 MB however many tokens the block asks for.
    step = min(SLICE_ROWS, max(16, SLICE_SCORES // len(block["ids"])), max(16, 8_000_000 // max(1, len(block["asked"]))))
    for start in range(0, docs.num_rows, step):
        part = docs.slice(start, step).combine_chunks()
        age = part.column("age_days").to_numpy()
        recency = np.ones(len(age)) if half_life <= 0 else np.where(age <= 0, 1.0, np.exp(-np.log(2) / half_life * age))
        if mode == "vector":
            rows, cols, semantic = _nearby(part, recency, block, k)
            keyword, exact = np.zeros(len(rows)), semantic * recency[rows]
        else:
            # Only vectors of the query's own length are similar to it; every length is scored by itself.
            has_vector = pc.fill_null(pc.list_value_length(part.column("vector")), 0).to_numpy() > 0
            semantic = np.zeros((part.num_rows, len(block["ids"])))
            if mode != "keyword":
                for places, unit, _ in block["by_length"]:
                    semantic[:, places] = _matrix(part.column("vector"), unit.shape[1]) @ unit.T
            keyword = np.zeros_like(semantic)
            if mode == "hybrid" or mode == "keyword":
                sizes = part.column("n_tokens").to_numpy()
                tokens = part.column("tokens").combine_chunks()
                owner = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
                place = pc.fill_null(pc.index_in(tokens.flatten(), block["asked"]), -1).to_numpy(zero_copy_only=False)
                held = np.zeros((part.num_rows, len(block["asked"])), np.float32)
                held[owner[place >= 0], place[place >= 0]] = 1
                keyword = (held @ block["asks"]).astype(np.float64)
                union = sizes[:, None] + block["n_tokens"][None, :] - keyword
                keyword = np.divide(keyword, union, out=np.zeros_like(keyword), where=union > 0)
            both = has_vector[:, None] & has_query_vector[None, :]
            if mode == "hybrid":
                base = np.where(both, KEYWORD_WEIGHT * keyword + SEMANTIC_WEIGHT * semantic, keyword)
            else:
                base = keyword if mode == "keyword" else semantic
            whole = base * recency[:, None]
            if mode == "semantic":
                whole[~has_vector] = -np.inf
            if not block["seen"] and len(whole) >= k:
                # The k-th best of this slice bounds what can still win; ties stay in and are settled by id later.
                reached = np.partition(np.where(np.isnan(whole), -np.inf, whole), len(whole) - k, axis=0)[len(whole) - k]
                block["floor"] = np.maximum(block["floor"], np.where(np.isfinite(reached), _rounded(np.where(np.isfinite(reached), reached, 0)), -np.inf))
            block["seen"] = True
            rows, cols = np.nonzero(whole >= block["floor"] - 1e-6)
            exact, keyword, semantic = whole[rows, cols], keyword[rows, cols], semantic[rows, cols]
        score = _rounded(exact)
        keep = (score >= block["floor"][cols]) & np.isfinite(score)
        if minimum is not None:
            keep &= exact >= minimum
        rows, cols = rows[keep], cols[keep]
        yield pa.table(
            [
                pa.array(cols.astype(np.int32)),
                part.column("id").take(pa.array(rows)),
                pa.array(score[keep]),
                pa.array(_rounded(keyword[keep])),
                pa.array(_rounded(semantic[keep])),
                pa.array(_rounded(recency[rows])),
            ],
            names=["query", "id", "score", "keyword_score", "semantic_score", "recency_factor"],
        )


def _query_block(queries: pa.Table, minimum: float | None) -> dict:
    """What the queries of a block ask for, in the form _best_of works on, and what was found for them so far."""
    vectors = queries.column("vector").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    by_length = [(np.flatnonzero(sizes == dim), _matrix(vectors, int(dim))[sizes == dim]) for dim in np.unique(sizes[sizes > 0])]
    tokens = queries.column("tokens").combine_chunks()
    n_tokens = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    coded = tokens.flatten().dictionary_encode()
    asks = np.zeros((len(coded.dictionary), queries.num_rows), np.float32)  # which query asks for which token
    asks[coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(queries.num_rows), n_tokens)] = 1
    return {
        "ids": queries.column("query_id").combine_chunks(),
        "by_length": [(places, unit, unit.astype(np.float32)) for places, unit in by_length],
        "has_vector": sizes > 0,
        "n_tokens": n_tokens.astype(np.float64),
        "asked": coded.dictionary,
        "asks": asks,
        "floor": np.full(queries.num_rows, -np.inf if minimum is None else minimum),
        "seen": False,
        "found": [],
    }


def _merge(block: dict, k: int) -> None:
    """Keep the best k rows of each query of what was found; the k-th bounds what can still win."""
    found = pa.concat_tables(block["found"]).sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
    query = found.column("query").to_numpy()
    first = np.flatnonzero(np.diff(query, prepend=-1))
    place = np.arange(len(query)) - np.repeat(first, np.diff(first, append=len(query)))
    last = place == k - 1
    floor = block["floor"]
    floor[query[last]] = np.maximum(floor[query[last]], found.column("score").to_numpy()[last])
    block["found"] = [found.filter(pa.array(place < k))]


def _tiles(mode: str, k: int, minimum: float | None, half_life: float):
    """Best k documents of those that come by for every query that a task holds: they merge with those of other tasks."""

    def meet(pairs: Pairs) -> Iterator[pa.RecordBatch]:
        asked: dict[int, dict] = {}
        docs, held = None, None
        for a_no, a, b_no, b in pairs:
            if b_no not in asked:
                asked[b_no] = _query_block(blocks.rows_of(b), minimum)
            if a_no != held:
                docs, held = blocks.rows_of(a), a_no
            block = asked[b_no]
            for found in _best_of(docs, block, mode, k, minimum, half_life):
                block["found"].append(found)
                if sum(t.num_rows for t in block["found"]) > (MERGED + k) * len(block["ids"]):
                    _merge(block, k)
        for block in asked.values():
            if block["found"]:
                _merge(block, k)
                found = block["found"][0].combine_chunks()
                query_id = block["ids"].take(found.column("query").combine_chunks())
                yield from pa.table([query_id, *found.columns[1:]], ["query_id", *found.column_names[1:]]).to_batches()

    return meet


def _score(
    docs: DataFrame, queries: DataFrame, mode: str, k: int, minimum: float | None, half_life: float
) -> DataFrame:
    """docs(id, vector, tokens, age_days) x queries(query_id, vector, tokens) -> best k per query.

    Documents and queries are written once, in blocks.  All pairs of blocks meet without a shuffle: a task streams documents past a
    block of queries and returns the best k of each, so disk grows with documents and queries, not with their pairs.
    """
    narrow = docs.select(
        F.col("id").cast("string").alias("id"),
        _numbers(docs),
        "tokens",
        F.size("tokens").cast("double").alias("n_tokens"),
        F.col("age_days").cast("double").alias("age_days"),
    )
    asked = queries.select("query_id", _numbers(queries), "tokens")
    query_id = asked.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_id}, id string, score double, keyword_score double, semantic_score double, recency_factor double"
    narrow, asked = blocks.packed(narrow, "documents", TILE_DOCUMENTS), blocks.packed(asked, "queries", QUERY_BLOCK)
    found = blocks.in_pairs(narrow, asked, _tiles(mode, k, minimum, half_life), schema)
    return ordered.top_rows(found, ["query_id"], [F.desc("score"), F.asc("id")], k)


def _numbers(rows: DataFrame) -> Column:
    """The column `vector` as arrays of doubles, or of floats if it has these; they are scored in doubles."""
    kept = rows.schema["vector"].dataType.simpleString() == "array<float>"
    return F.col("vector") if kept else F.col("vector").cast("array<double>").alias("vector")


_NO_TOKENS = "CAST(array() AS array<string>)"


def vector_top_k(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Cosine similarity, best first; documents without similarity still fill up to k."""
    d = docs.select("id", F.coalesce("vector", F.array().cast(docs.schema["vector"].dataType)).alias("vector"),
                    F.expr(_NO_TOKENS).alias("tokens"), F.lit(0.0).alias("age_days"))
    q = queries.select("query_id", "vector", F.expr(_NO_TOKENS).alias("tokens"))
    return _score(d, q, "vector", k, None, 0.0).select("query_id", "id", "score", "rank")


def hybrid_recall(docs: DataFrame, queries: DataFrame, k: int = RECALL_RESULTS) -> DataFrame:
    """docs(id, content, vector, age_days), queries(query_id, query, vector)."""
    d = docs.select("id", "vector", F.array_distinct(T.terms("content")).alias("tokens"), "age_days")
    q = queries.select("query_id", "vector", F.array_distinct(T.terms("query")).alias("tokens"))
    return _score(d, q, "hybrid", k, RECALL_MIN_SCORE, RECALL_HALF_LIFE)


def semantic_recall(docs: DataFrame, queries: DataFrame, k: int = RECALL_RESULTS) -> DataFrame:
    d = docs.select("id", "vector", F.expr(_NO_TOKENS).alias("tokens"), "age_days")
    q = queries.select("query_id", "vector", F.expr(_NO_TOKENS).alias("tokens"))
    return _score(d, q, "semantic", k, RECALL_MIN_SCORE, RECALL_HALF_LIFE)


def keyword_recall(docs: DataFrame, queries: DataFrame, k: int = RECALL_RESULTS) -> DataFrame:
    """Jaccard of token sets times recency.  Only pairs that share a token can score, so an equi-join finds them all."""
    asked = queries.select("query_id", F.array_distinct(T.terms("query")).alias("tokens"))
    terms = asked.select("query_id", F.size("tokens").alias("q_size"), F.explode("tokens").alias("token"))
    tokens = F.array_distinct(T.terms("content"))
    held = docs.select("id", "age_days", tokens.alias("tokens")).select(
        "id", "age_days", F.size("tokens").alias("d_size"), F.explode("tokens").alias("token")
    )
    shared = (
        held.join(terms, "token")
        .groupBy("query_id", "id", "age_days", "q_size", "d_size")
        .agg(F.count("*").alias("n"))
    )
    keyword = F.col("n") / (F.col("q_size") + F.col("d_size") - F.col("n"))
    factor = T.recency(F.col("age_days"), RECALL_HALF_LIFE)
    scored = shared.select(
        "query_id",
        "id",
        (keyword * factor).alias("__exact"),
        F.round(keyword * factor, 6).alias("score"),
        F.round(keyword, 6).alias("keyword_score"),
        F.round(factor, 6).alias("recency_factor"),
    ).where(F.col("__exact") >= RECALL_MIN_SCORE)
    return ordered.top_rows(scored.drop("__exact"), ["query_id"], [F.desc("score"), F.asc("id")], k)


def session_documents(sessions: DataFrame) -> DataFrame:
    """Search text of a session: title and tags; archived sessions stay out, deleted ones do not."""
    text: Column = F.concat_ws(" ", "title", F.array_join("tags", " "))
    return sessions.where(~F.col("is_archived")).select(F.col("session_id").cast("string").alias("id"), text.alias("content"))

