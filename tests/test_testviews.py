"""The adapter views on documents whose ids repeat or are missing equal plain grouping; their words are not shuffled."""

import re
from collections import Counter

import pytest

from threadloom.plans import memory as P
from threadloom.sources import testviews as V

DOCS = [
    (1, "Beta alpha beta gamma. beta", "en"), (2, None, "en"), (3, "alpha " * 30, None), (4, "", "fr"), (60, "zeta alpha", "de"),
    (7, "one two two", "en"), (7, "two three", "fr"), (None, "alpha lost", "en"), (None, "lost lost", "de"),
]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def words(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def test_session_entities(spark, folder):
    want = []
    for i in {d[0] for d in DOCS}:
        own = [d for d in DOCS if d[0] == i]
        n = Counter(w for d in own for w in words(d[1]))
        named = [(w, min(1.0, c / 20)) for w, c in n.items()] + [(lang and f"topic {lang}", 0.2) for _, _, lang in own]
        named.sort(key=lambda x: (x[0] is not None, x[0] or ""))
        kind = lambda w: "tech" if w and " " not in w and len(w) % 2 == 0 else "concept"
        want += [(i, w, kind(w), s, ix) for ix, (w, s) in enumerate(named, 1)]
    got = V.session_entities(spark, folder).select("session_seq", "name", "type", "importance", "item_ix").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert P.entities(spark, folder).count() == len(want)


def test_gazetteer(spark, folder):
    """A word of one in four of the rows' ids; copies of an id count once."""
    held = Counter(w for i in {d[0] for d in DOCS} for w in {w for d in DOCS if d[0] == i for w in words(d[1])})
    got = {r["term"] for r in V.load(spark, folder, "v_gazetteer").collect()}
    assert got == {w for w, n in held.items() if n * V.TERM_SHARE >= len(DOCS)} and "alpha" in got


def test_words_of_single_documents_are_not_shuffled(spark, tmp_path):
    spark.createDataFrame([d for d in DOCS if d[0] not in (None, 7)], "doc_id bigint, text string, lang string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    plan = P.entities(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_entities_meet_in_one_shuffle(spark):
    """Merging equals the rule worked out entity by entity, with one shuffle of the rows."""
    import random

    from threadloom.operators import memory as M

    rng = random.Random(5)
    spelled = ["Redis", "redis", "REDIS", " redis ", "Kafka", "kafka", "topic"]
    rows = []
    for u in (1, 2, None):
        for session in range(6):
            for ix in range(4):
                name = rng.choice([*spelled, None])
                also = rng.sample(["kafka", "Redis", "other", None], rng.randrange(3))
                rows.append((u, session, ix, float(rng.randrange(90)), name, "tech", rng.random(), also, ix))
    schema = "user_id bigint, session_seq bigint, item_ix int, age_days double, name string, type string, importance double, aliases array<string>, first_mentioned_at int"
    frame = spark.createDataFrame(rows, schema)
    key = lambda n: None if n is None else n.lower().strip()
    want = {}
    for u in (1, 2):
        for k in {key(r[4]) for r in rows if r[0] == u} - {None}:
            own = [r for r in rows if r[0] == u and key(r[4]) == k]
            first = min(r[1:3] for r in own)
            names = {a for r in own for a in r[7]} | {r[4] for r in own if r[1:3] > first or sum(x[4] == r[4] for x in own) > 1}
            names |= {r[4] for r in rows if r[0] == u and key(r[4]) not in (k, None) and k in map(key, r[7]) and r[1:3] > first}
            want[u, k] = (names - {None}, len({r[1] for r in own}), len(own))
    merged = M.merge_entities(frame)
    got = {(r["user_id"], r["key"]): (r["name"], list(r["aliases"]), r["session_count"], r["mentions"]) for r in merged.collect()}
    assert {k: (sorted(a for a in v[0] if a != got[k][0]), *v[1:]) for k, v in want.items()} == {k: v[1:] for k, v in got.items()}
    assert exchanges(M.merge_entities(frame)) == 1 and exchanges(M.entity_session_counts(frame)) == 1


def test_texts_are_told_apart_without_being_shuffled(spark):
    from threadloom.operators import memory as M

    rows = [(1, "One Text ", "completed"), (1, "one text", "active"), (1, "other", "active"), (2, None, "active"), (2, "x", "blocked")]
    tasks = spark.createDataFrame(
        [(u, i, 0, d, 30.0, 0.5, s) for i, (u, d, s) in enumerate(rows)],
        "user_id bigint, session_seq bigint, item_ix int, description string, age_days double, priority double, status string",
    )
    names = spark.createDataFrame([(1, "A"), (1, "a "), (2, None)], "user_id bigint, name string")
    counts = M.distinct_counts(names, tasks.where("status = 'active'"), tasks)
    assert {tuple(r) for r in counts.collect()} == {(1, 1, 2, 2), (2, 1, 1, 2)}
    assert {(r["user_id"], r["subject"]) for r in M.stalled_tasks(tasks).collect()} == {(1, "other"), (2, None)}


def test_growing_sides_are_not_broadcast(spark):
    """However small the sides of a test, names and windows are not collected on the driver."""
    from threadloom.operators import entities as E

    texts = spark.createDataFrame([(1, 0, "Docker uses Redis"), (1, 1, "nothing")], "conv_id bigint, turn int, full_text string")
    rank = "struct<n:bigint,at:struct<turn:int,source:int,ix:bigint>>"
    named = spark.createDataFrame([(1, n, (0, (0, 1, i))) for i, n in enumerate(("docker", "redis"))], f"conv_id bigint, low string, rank {rank}")
    edges = E.verb_edges(texts, named)
    assert [(r["src"], r["dst"], r["relationship"]) for r in edges.collect()] == [("docker", "redis", "uses")]
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
