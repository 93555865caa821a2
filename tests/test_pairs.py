"""Pairs of a key in tiles, and names inside texts, against plain loops."""

import collections
import itertools
import random

import pyarrow as pa

from threadloom.functions import tiles
from threadloom.functions.substrings import occurring
from threadloom.operators import consensus, memory


def test_every_pair_meets_once_and_no_tile_is_large(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 16)
    rows = [("many", i) for i in range(700)] + [("few", i) for i in range(5)] + [("one", 1)]

    def meet(table, left, right):
        ids = table.column("x").to_pylist()
        same = len(left) == len(right) and (left == right).all()
        pairs = [(a, b) for a in left for b in right if not same or a < b]
        out = [sorted((ids[a], ids[b])) for a, b in pairs]
        who = table.column("k")[0].as_py()
        return pa.table({"k": [who] * len(out), "a": [p[0] for p in out], "b": [p[1] for p in out], "n": [table.num_rows] * len(out)},
                        pa.schema([("k", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]))

    got = tiles.in_tiles(spark.createDataFrame(rows, "k string, x bigint"), ["k"], "x", meet, "k string, a bigint, b bigint, n bigint").collect()
    pairs = collections.Counter((r["k"], r["a"], r["b"]) for r in got)
    assert set(pairs.values()) == {1}
    assert set(pairs) == {("many", a, b) for a, b in itertools.combinations(range(700), 2)} | {("few", a, b) for a, b in itertools.combinations(range(5), 2)}
    sizes = sorted(r["n"] for r in got if r["k"] == "many")
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_conflicts_of_a_user_with_many_texts(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 20)
    monkeypatch.setattr(tiles, "CHUNK", 7)
    rng = random.Random(1)
    pool = [f"t{i}" for i in range(40)] + ["postgres", "mysql", "react", "vue"]
    rows = [("u" if i % 9 else "v", i, 0, " ".join(rng.sample(pool, rng.randrange(1, 7))) if i else "", "", "active") for i in range(250)]
    rows += [("u", 300, 0, rows[1][3], "", "active"), ("u", 301, 0, "t1", "", "superseded")]
    frame = spark.createDataFrame(rows, "user_id string, session_seq bigint, item_ix int, description string, rationale string, status string")
    from threadloom.functions import dims

    against = set(dims.opposing_words())
    texts = collections.defaultdict(set)
    for user, _, _, text, _, status in rows:
        if status == "active":
            texts[user].add(text)
    want = set()
    for user, all_texts in texts.items():
        for a, b in itertools.combinations_with_replacement(sorted(all_texts), 2):
            x, y = set(a.split()), set(b.split())
            overlap = len(x & y) / len(x | y) if x | y else 0.0
            opposing = any((v, w) in against for v in x for w in y)
            if opposing or overlap >= 0.25:
                want.add((user, a, b, round(overlap, 4), "opposing_choice" if opposing else "scope_overlap"))
    ids = memory._conflict_texts(frame)[1].select("user_id", "text_id", "text")
    named = {r["text_id"]: r["text"].strip() for r in ids.collect()}
    got = [tuple(r) for r in memory.conflicting_texts(frame, 0.25).collect()]
    found = {(u, *sorted((named[a], named[b])), o, kind) for u, a, b, o, kind in got}
    assert len(found) == len(got) and found == want
    about = {(u, *sorted((named[a], named[b]))) for u, a, b, _, _ in memory.conflicting_texts(frame, 0.25, "t1").collect()}
    assert about == {w[:3] for w in want if "t1" in w[1] or "t1" in w[2]}


def test_agreement_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK_ROWS", 8)
    rng = random.Random(2)
    rows = [(1, i, " ".join(rng.choices(["alpha", "bravo", "charlie", "delta", "echo"], k=3)), False) for i in range(60)] + [(2, 0, "alpha", False)]
    frame = spark.createDataFrame(rows, "prompt_id bigint, answer_id bigint, content string, error boolean")
    prompts = spark.createDataFrame([(1,), (2,), (3,)], "prompt_id bigint")
    sets = [set(r[2].split()) for r in rows if r[0] == 1]
    pairs = [len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2)]
    got = {r["prompt_id"]: r["agreement_score"] for r in consensus.agreement(prompts, frame).collect()}
    assert abs(got[1] - sum(pairs) / len(pairs)) < 1e-4 and got[2] == got[3] == 0.0


def test_names_inside_texts(spark):
    rng = random.Random(3)
    texts = [(i % 3, "".join(rng.choices("ab é\n😀", k=rng.randrange(0, 40)))) for i in range(60)] + [(0, None), (1, "")]
    texts += [(2, "x" * 50_000 + "end of it" + "y" * 50_000)]
    needles = {(k, "".join(rng.choices("ab é😀", k=n))) for k in range(4) for n in range(0, 9) for _ in range(12)}
    needles |= {(2, "xend of ity"), (2, "xend of itz"), (0, None)} | {t for t in texts[:5]}
    t = spark.createDataFrame(texts, "k int, text string")
    got = [tuple(r) for r in occurring(spark.createDataFrame(list(needles), "k int, needle string"), t, ["k"]).collect()]
    want = {(k, n) for k, n in needles if n is not None and any(k == j and x is not None and n in x for j, x in texts)}
    assert len(got) == len(set(got)) and set(got) == want
    assert occurring(spark.createDataFrame([], "k int, needle string"), t, ["k"]).count() == 0
