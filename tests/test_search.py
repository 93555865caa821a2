"""Index segments against a rebuild, pages without all hits against plain scoring, tiled top-k against one matrix product."""

import math
import random
import re

import numpy as np
import pytest

from threadloom.operators import index as I
from threadloom.operators import search as S

WORDS = [f"w{i}" for i in range(60)] + ["common", "usual"]


def texts(n, seed):
    rng = random.Random(seed)
    rows = [(f"d{i:03}", " ".join(rng.choices(WORDS, weights=[*range(1, 61), 200, 150], k=rng.randrange(1, 60)))) for i in range(n)]
    return rows + [("empty", ""), ("null", None), ("marks", "-- !")]


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def content(index):
    posts = {(r["token"], r["id"]): (r["tf"], r["length"]) for r in index.postings().collect()}
    sizes = {r["id"]: r["length"] for r in index.lengths().collect()}
    return posts, sizes, {r["token"]: r["df"] for r in index.vocabulary().collect()}, index.statistics()


def expected(docs):
    posts, df = {}, {}
    for i, text in docs.items():
        t = tokens(text)
        for w in set(t):
            posts[w, i] = (t.count(w), len(t))
            df[w] = df.get(w, 0) + 1
    sizes = {i: len(tokens(t)) for i, t in docs.items()}
    return posts, sizes, df, (len(docs), pytest.approx(sum(sizes.values()) / len(docs)))


def test_segments_equal_a_rebuild(spark, tmp_path):
    docs = dict(texts(120, 1))
    frame = lambda rows: spark.createDataFrame(list(rows), "id string, content string")
    path = str(tmp_path / "corpus")
    frame(docs.items()).write.parquet(path)
    index = I.SearchIndex.build(spark.read.parquet(path))
    assert content(index) == expected(docs)
    renewed = {"d003": "fresh common text", "d004": None, "new": "w1 w1 w2"}
    index.apply(frame(renewed.items()), frame([("d005", ""), ("unknown", "")]).select("id"))
    docs |= renewed
    del docs["d005"]
    assert content(index) == expected(docs)
    index.apply(frame([("d005", "back again"), ("new", "w3")]))
    docs |= {"d005": "back again", "new": "w3"}
    assert content(index) == expected(docs)
    assert content(index.compact()) == expected(docs)
    # A segment without statistics was never finished and does not count.
    index._put(frame([("d006", "")]).select("id"), "tombstones", 9)
    assert content(index) == expected(docs)


def test_upkeep_reads_the_new_texts_and_the_index_only(spark, tmp_path):
    corpus, change = str(tmp_path / "corpus"), str(tmp_path / "change")
    frame = spark.createDataFrame(texts(50, 2), "id string, content string")
    frame.write.parquet(corpus)
    frame.limit(3).write.parquet(change)
    index = I.SearchIndex.build(spark.read.parquet(corpus), str(tmp_path / "index"))
    read = []
    put = I.SearchIndex._put

    def noted(self, df, name, segment):
        read.extend(df.inputFiles())
        return put(self, df, name, segment)

    I.SearchIndex._put = noted
    try:
        index.apply(spark.read.parquet(change))
    finally:
        I.SearchIndex._put = put
    assert read and not any("/corpus/" in f for f in read) and any("/change/" in f for f in read)


def scores(docs, query):
    t = {i: tokens(x) for i, x in docs.items()}
    average = sum(map(len, t.values())) / len(t)
    out = {}
    for w in tokens(query):
        df = sum(w in x for x in t.values())
        for i, x in t.items():
            if w in x:
                tf = x.count(w)
                idf = math.log((len(t) - df + 0.5) / (df + 0.5) + 1)
                out[i] = out.get(i, 0) + idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(x) / average))
    return out


@pytest.mark.parametrize("heavy,rare", [(1, 1_000), (2_048, 10)])
def test_pages_without_all_hits(spark, monkeypatch, heavy, rare):
    monkeypatch.setattr(I, "HEAVY", heavy)
    monkeypatch.setattr(I, "RARE", rare)
    docs = dict(texts(300, 3)) | {f"copy{i}": "w5 common w7" for i in range(12)}
    queries = [(1, "w5 common w7"), (2, "common usual w60 w60 W1"), (3, "nothing"), (4, ""), (5, None), (6, " ".join(WORDS)), (7, "w59")]
    index = I.SearchIndex.build(spark.createDataFrame(list(docs.items()), "id string, content string"))
    asked = spark.createDataFrame(queries, "query_id bigint, query string")
    some = [i for i in docs if i.endswith(("1", "4", "7"))]
    for page, size, within in ((1, 5, None), (2, 5, None), (2, 4, some)):
        frame = None if within is None else spark.createDataFrame([(i,) for i in within], "id string")
        got = {tuple(r) for r in I.result_page(asked, index, page, size, frame).select("query_id", "rank", "id", "score", "total").collect()}
        want = set()
        for q, text in queries:
            hits = {i: round(s, 6) for i, s in scores(docs, text or "").items() if within is None or i in within}
            ranked = sorted(hits.items(), key=lambda x: (-x[1], x[0]))
            want |= {(q, n, i, s, len(hits)) for n, (i, s) in enumerate(ranked, 1) if (page - 1) * size < n <= page * size}
        assert got == want


def test_a_page_joins_few_of_the_hits(spark):
    """Frequent tokens bring in no candidates of their own when a rarer one decides."""
    rng = random.Random(4)
    docs = [(f"d{i}", "common usual " * 3 + ("jewel " * 5 if i % 500 == 0 else "") + f"w{rng.randrange(50)}") for i in range(5000)]
    frame = spark.createDataFrame(docs, "id string, content string")
    asked = spark.createDataFrame([(1, "jewel common usual")], "query_id bigint, query string")
    formed, put = {}, I.saved

    def noted(df, purpose):
        formed[purpose] = put(df, purpose)
        return formed[purpose]

    I.saved = noted
    try:
        got = I.result_page(asked, I.SearchIndex.build(frame), 1, 5).collect()
    finally:
        I.saved = put
    assert len(got) == 5 and got[0]["total"] == 5000
    assert formed["candidates"].count() <= 20


def test_tiles_answer_as_one_product(spark, monkeypatch):
    rng = np.random.default_rng(0)
    docs = [(f"v{i}", rng.normal(size=3 + i % 2).tolist(), ["a", f"t{i % 7}"], float(i % 9)) for i in range(90)] + [("none", None, [], 0.0)]
    queries = [(i, rng.normal(size=3).tolist(), ["a", f"t{i}"]) for i in range(10)] + [(77, None, ["a"]), (78, [0.0, 0.0, 0.0], [])]
    d = spark.createDataFrame(docs, "id string, vector array<double>, tokens array<string>, age_days double")
    q = spark.createDataFrame(queries, "query_id bigint, vector array<double>, tokens array<string>")
    whole = {m: {tuple(r) for r in S._score(d, q, m, 4, None, 30.0).collect()} for m in ("vector", "hybrid")}
    for name, value in (("TILE_DOCUMENTS", 10), ("QUERY_BLOCK", 3), ("MERGED", 4)):
        monkeypatch.setattr(S, name, value)
    for mode, rows in whole.items():
        assert {tuple(r) for r in S._score(d, q, mode, 4, None, 30.0).collect()} == rows and len(rows) == 48
    empty = q.where("query_id < 0")
    assert S._score(d, empty, "vector", 4, None, 0.0).count() == 0 and S._score(d.where("id = ''"), q, "hybrid", 4, None, 0.0).count() == 0


def test_every_vector_asks(spark, tmp_path):
    """The best of every vector, not of some."""
    from threadloom.plans.search import embedding_top_k

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(30, 4))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["query_id"], r["rank"]): r["id"] for r in embedding_top_k(spark, str(tmp_path)).collect()}
    unit = vectors.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    best = np.argsort(-(unit @ unit.T), axis=1)[:, :10]
    assert got == {(q, n): str(i) for q, found in enumerate(best) for n, i in enumerate(found, 1)}


@pytest.mark.parametrize("sent", (1000, 0))
def test_scores_are_added_where_a_document_is(spark, monkeypatch, sent):
    """BM25 equals plain scoring, ids that repeat included; the pairs of query and token are not shuffled by query."""
    monkeypatch.setattr(S, "SENT_TOKENS", sent)
    docs = {i: t for i, t in texts(80, 6) if t is not None}
    frame = spark.createDataFrame(list(docs.items()), "id string, content string")
    asked = spark.createDataFrame([(1, "w5 common w7 w7"), (2, "common usual"), (3, None), (4, "nothing")], "query_id bigint, query string")
    hits = S.bm25(asked, S.postings(frame), S.lengths(frame))
    got = {(r["query_id"], r["id"]): r["score"] for r in hits.collect()}
    want = {(q, i): round(s, 6) for q, text in ((1, "w5 common w7 w7"), (2, "common usual")) for i, s in scores(docs, text).items()}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0}, abs=2e-6)
    by_pair = "hashpartitioning(query_id" in hits._jdf.queryExecution().executedPlan().toString()
    assert by_pair == (sent == 0)
    twice = frame.unionByName(spark.createDataFrame([("d003", docs["d003"]), ("d004", "w1 w1"), (None, "w2"), (None, "w2 w2 w9")], "id string, content string"))
    posts = {(r["token"], r["id"], r["length"]): r["tf"] for r in S.postings(twice).collect()}
    n = len(tokens(docs["d003"]))
    assert all(posts[w, "d003", n] == 2 * tokens(docs["d003"]).count(w) for w in tokens(docs["d003"]))
    assert posts["w1", "d004", 2] == 2 and posts["w2", None, 1] == 1 and posts["w2", None, 3] == 2


def test_documents_are_not_copied_for_each_block_of_queries(spark, monkeypatch):
    """Blocks meet without a shuffle of the rows: nothing is exploded, and each row is written in one block."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    d = spark.createDataFrame(rows, "id bigint, vector array<float>")
    for name in ("TILE_DOCUMENTS", "QUERY_BLOCK"):
        monkeypatch.setattr(S, name, 7)
    kept = []
    packed = S.blocks.packed
    monkeypatch.setattr(S.blocks, "packed", lambda *a, **b: kept.append(packed(*a, **b)) or kept[-1])
    found = S.vector_top_k(d, d.withColumnRenamed("id", "query_id"), 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "CoGroup" not in plan
    for blocks in kept:
        assert blocks.agg({"rows": "sum"}).first()[0] == 60 and blocks.agg({"rows": "max"}).first()[0] <= 7
    unit = np.array([v for _, v in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    best = np.argsort(-(unit @ unit.T), axis=1)[:, :3]
    assert {(r.query_id, r.rank): r.id for r in found.collect()} == {(q, n): str(i) for q, ids in enumerate(best) for n, i in enumerate(ids, 1)}


def test_blocks_of_small_partitions_are_put_together(spark):
    import pyarrow as pa

    from threadloom.functions import blocks

    got = blocks.packed(spark.range(500).repartition(60), "blocks", 100)
    assert got.count() <= 20
    rows = [r for b in got.collect() for r in blocks.rows_of(pa.scalar(bytes(b.block))).column("id").to_pylist()]
    assert sorted(rows) == list(range(500))
    sorted_rows = spark.range(300).selectExpr("id", "id DIV 30 AS g").coalesce(1).sortWithinPartitions("g")
    groups = [blocks.rows_of(pa.scalar(bytes(b.block))).column("g").to_pylist() for b in blocks.packed(sorted_rows, "blocks", 20, "g").collect()]
    assert sorted((g[0], len(g)) for g in groups) == sorted((g, n) for g in range(10) for n in (20, 10)) and all(len(set(g)) == 1 for g in groups)


@pytest.mark.parametrize("mode", ["vector", "semantic", "hybrid"])
def test_ties_copies_and_odd_vectors(spark, monkeypatch, mode):
    """The prefilter in short numbers loses no pair: copies, near copies, zero and negative vectors, ids that repeat, against plain loops."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=6)
    vectors = [base, base, -base, base * (1 + 1e-7), np.zeros(6), *(base + rng.normal(size=6) * 10.0**-e for e in range(8)), *rng.normal(size=(20, 6)), *np.eye(6), rng.normal(size=3)]
    docs = [(f"d{i % 30}", v.tolist(), ["a"], float(i % 5)) for i, v in enumerate(vectors)] + [("none", None, [], 1.0), ("none", [], [], 1.0)]
    queries = [(i % 20, v.tolist(), ["a"]) for i, v in enumerate(vectors)] + [(None, base.tolist(), ["b"])]
    for name, value in (("TILE_DOCUMENTS", 5), ("QUERY_BLOCK", 4), ("MERGED", 1)):
        monkeypatch.setattr(S, name, value)
    d = spark.createDataFrame(docs, "id string, vector array<double>, tokens array<string>, age_days double")
    q = spark.createDataFrame(queries, "query_id bigint, vector array<double>, tokens array<string>")

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or not any(a) or not any(b):
            return 0.0
        return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))

    want = {}
    for qid, qv, qt in queries:
        for i, v, t, age in docs:
            if mode == "semantic" and not v:
                continue
            c, word = cosine(qv, v), len({*qt} & {*t}) / len({*qt} | {*t})
            s = c if mode != "hybrid" else S.KEYWORD_WEIGHT * word + S.SEMANTIC_WEIGHT * c if qv and v else word
            want.setdefault(qid, []).append((-round(s * 0.5 ** (age / 30.0), 6) + 0.0, i))
    got = {}
    for r in S._score(d, q, mode, 6, None, 30.0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.id))
    assert got.keys() == want.keys()
    for qid, rows in got.items():
        assert [(-s + 0.0, i) for _, s, i in sorted(rows)] == [(pytest.approx(s, abs=2e-6), i) for s, i in sorted(want[qid])[:6]]
