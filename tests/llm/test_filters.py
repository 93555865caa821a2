"""Quality rules, benchmark search and their unusual rows."""

import random

from threadloom.llm import decontaminate as dc
from threadloom.llm import quality_rules as qr


def brute_measures(text):
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in (i, i + 1, i + 2)}
    lines = [line for line in (text or "").split("\n") if line.encode().split()]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": sum(line in lines[:i] for i, line in enumerate(lines)),
        "n_repeat_words": len(covered),
    }


def test_measures_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "a", "a b", "a b c", "a a a a", "x y z x y z", "x\ny\nx\n\n", "é ü #*$ <>|&%", "tab\tand\x0bvt\x0c", "日本 語"]
    texts += ["".join(rng.choice(["a ", "b ", "the ", "\n", "of\n", "# ", "c"]) for _ in range(rng.randint(1, 150))) for _ in range(150)]
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, kept string")
    got = {r.doc_id: r for r in qr.judge(docs).collect()}
    for i, text in enumerate(texts):
        want = brute_measures(text)
        assert {k: got[i][k] for k in want} == want, text
        assert got[i].base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (got[i].base_failed and got[i].kept)


def test_rules_name_what_failed(spark):
    words = " ".join(f"word{i} the" for i in range(60))
    rows = [(1, words), (2, words.replace("word", "## word")), (3, words.replace("the", "qqq")), (4, words + "\n" + "same line\n" * 9), (5, "the " * 80)]
    got = {r.doc_id: r for r in qr.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].kept and got[1].failed_rules == []
    assert got[2].failed_rules == ["symbols_per_word"] and not got[2].kept
    assert got[3].failed_rules == ["stop_word_share"]
    assert "duplicate_line_share" in got[4].failed_rules
    assert got[5].base_failed and not got[5].kept
    assert qr.judge(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def brute_hits(text, items, window=13):
    words = dc.bench_words(text)
    hit, names = set(), set()
    for name, body in items:
        ws = dc.bench_words(body)
        m = min(window, len(ws))
        for i in range(len(ws) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == ws[i : i + m]:
                    hit |= set(range(j, j + m))
                    names.add(name)
    return len(words), len(hit), names


def test_wu_manber_equals_brute_force():
    rng = random.Random(9)
    make = lambda n: " ".join(rng.choice("abc") for _ in range(n)).encode()
    for _ in range(60):
        items = [(str(i), make(rng.randint(0, 12))) for i in range(6)]
        text = make(rng.randint(0, 60))
        tables = dc.compile_patterns(items, window=5)
        spans, names = dc.search(dc.bench_words(text), tables)
        assert (len(dc.bench_words(text)), dc.covered(spans), names) == brute_hits(text, items, 5)


def test_contamination_of_unusual_rows(spark):
    passage = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    bench = spark.createDataFrame([("q1", passage), (None, "short one"), ("q2", None), ("q3", ""), ("q4", passage)], "item_id string, text string")
    rows = [
        (1, passage.upper() + "!", "x"),
        (2, "filler " * 400 + passage, "x"),
        (3, "a short, one.", "x"),
        (None, None, "x"),
        (4, "", "x"),
        (1, passage.upper() + "!", "x"),
        (5, "Alpha beta gamma delta", None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_hit string")
    for limit in (1, 1 << 20):  # one block per item, and one block for all
        got = {r.doc_id: r for r in dc.contamination(docs, bench, block_bytes=limit).collect()}
        assert (got[1].n_words, got[1].n_hit, got[1].hit_items, got[1].contaminated) == (14, 14, ["q1", "q4"], True)
        assert (got[2].n_words, got[2].n_hit, got[2].contaminated) == (414, 14, False)
        assert (got[3].n_hit, got[3].hit_items, got[3].contaminated) == (2, [""], True)
        assert (got[None].n_words, got[None].n_hit, got[None].contaminated) == (0, 0, False)
        assert not got[4].contaminated and not got[5].contaminated
    assert dc.cleaned(docs, bench).columns == docs.columns
    assert dc.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert dc.contamination(docs.limit(0), bench).count() == 0


def test_one_block_of_patterns_needs_one_worker_per_task(spark):
    """Idle workers of a second step stay beside the next stage of the pipeline and count against an executor's memory."""
    bench = spark.createDataFrame([("q1", "alpha beta gamma"), ("q2", "delta epsilon")], "item_id string, text string")
    rows = [(1, "Alpha beta, gamma!"), (None, "x delta epsilon alpha"), (1, None), (1, "Alpha beta, gamma!")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    steps = lambda found: found._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    one, two = dc.contamination(docs, bench), dc.contamination(docs, bench, block_bytes=1)
    assert (steps(one), steps(two)) == (1, 2)
    want = [(1, 3, 3, ["q1"], True), (None, 4, 2, ["q2"], True), (1, 0, 0, [], False), (1, 3, 3, ["q1"], True)]
    for found in (one, two):
        got = [(r.doc_id, r.n_words, r.n_hit, r.hit_items, r.contaminated) for r in found.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
