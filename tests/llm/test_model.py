"""The recurrent language model: gradients, probabilities, counts and scores."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from threadloom.llm import recurrent_lm as lm


def tiny(seed=0, symbols=12, classes=4, size=3):
    rng = np.random.default_rng(seed)
    counts = np.sort(rng.integers(1, 60, symbols))[::-1].astype(float)
    shape = lm.layout(counts, classes)
    w = lm.Weights(*[(x.astype(float) + rng.normal(0, 0.4, x.shape)) for x in lm.initial(counts, shape, size)])
    return w, shape, [rng.integers(0, symbols, n) for n in (9, 5, 4, 1, 2)]


def one_by_one(w, shape, document):
    """The likelihood of a document, one step at a time, with plain formulas."""
    n = w.state.shape[0]
    h, total, previous = np.zeros(n), 0.0, len(w.inputs) - 1
    sig = lambda x: 1 / (1 + np.exp(-x))
    for s in document:
        x, g = w.inputs[previous], h @ w.state
        z, r = sig(x[:n] + g[:n]), sig(x[n : 2 * n] + g[n : 2 * n])
        c = np.tanh(x[2 * n :] + r * g[2 * n :])
        h = (1 - z) * c + z * h
        k = shape.of[s]
        a, b = shape.start[k], shape.start[k + 1]
        over = lambda y: np.exp(y) / np.exp(y).sum()
        total += math.log(over(h @ w.to_class + w.class_bias)[k])
        total += math.log(over(h @ w.to_symbol[:, a:b] + w.symbol_bias[a:b])[s - a])
        previous = s
    return total


@pytest.mark.parametrize(("lanes", "window"), [(1, 2), (3, 4), (8, 100)])
def test_scores_do_not_depend_on_lanes_and_windows(lanes, window):
    w, shape, documents = tiny()
    want = [one_by_one(w, shape, d) for d in documents]
    assert np.allclose(lm.score(w, shape, documents, lanes, window), want, atol=1e-5)
    assert lm.score(w, shape, []).shape == (0,)


def test_probabilities_add_up_to_one():
    w, shape, _ = tiny(3)
    h = np.random.default_rng(1).normal(0, 1, (5, 3))
    total = sum(np.exp(lm.log_probabilities(w, shape, h, np.full(5, s))) for s in range(12))
    assert np.allclose(total, 1)


def test_backpropagation_equals_differences(monkeypatch):
    """One window that holds whole documents: the step of the optimizer shows the gradient's sign and its zeros."""
    w, shape, documents = tiny(5)
    grads = []
    real = np.sqrt
    monkeypatch.setattr(lm, "RATE", 0.0)
    captured = lm.log_probabilities

    def keep(*a):
        if len(a) > 4:
            grads.append(a[4])
        return captured(*a)

    monkeypatch.setattr(lm, "log_probabilities", keep)
    lm.train(w, shape, documents, lanes=5, window=100)
    n = sum(map(len, documents))
    for part, (values, got) in enumerate(zip(w, grads[0], strict=True)):
        for at in list(np.ndindex(values.shape))[:: max(1, values.size // 25)]:
            moved = []
            for d in (1e-5, -1e-5):
                v = [x.copy() for x in w]
                v[part][at] += d
                moved.append(-sum(one_by_one(lm.Weights(*v), shape, x) for x in documents))
            assert math.isclose(got[at] * real(n), (moved[0] - moved[1]) / 2e-5, rel_tol=1e-3, abs_tol=1e-4), (part, at)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(2)
    documents = [np.tile([3, 1, 2, 5], 10) if rng.random() < 0.5 else np.tile([7, 8, 9], 12) for _ in range(80)]
    counts = np.bincount(np.concatenate(documents), minlength=12).astype(float)
    shape = lm.layout(counts, 4)
    number = np.argsort(np.argsort(-counts, kind="stable"), kind="stable")
    documents = [number[d] for d in documents]
    start = lm.initial(np.sort(counts)[::-1], shape)
    w = start
    for _ in range(5):
        w = lm.train(w, shape, documents)
    assert lm.score(w, shape, documents).sum() > 0.6 * lm.score(start, shape, documents).sum()


def brute_base(rows):
    tokens = [(r[1] or "").encode().lower().split() + [None] for r in rows]
    out = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 1 for r in rows]
    c = Counter(t for ts, o in zip(tokens, out) if not o for t in ts)
    n, v = sum(c.values()), len(c)
    return [(o, len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) for ts, o in zip(tokens, out)]


def test_query_on_a_table(spark, sf):
    from threadloom.llm import plans

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = dict(zip([r[0] for r in rows], brute_base(rows)))
    got = plans.QUERIES["op2_recurrent_lm"](spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert math.isclose(r.base_score, w[4], rel_tol=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_unusual_rows(spark):
    schema = "doc_id bigint, text string, score string, key string"
    rows = [(1, "a b a", "", ""), (1, "a b a", "", ""), (None, None, "", ""), (2, "", None, None), (3, "B  c\nzz", "", ""), (9, "q " * 3000, "", "")]
    got = lm.score_documents(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.n_tokens, r.n_known, round(r.base_score, 9)) for r in got) == sorted((w[1], w[2], round(w[4], 9)) for w in brute_base(rows))
    assert all(r.score < 0 for r in got)
    only_held_out = [(k, "a b") for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 1]
    got = lm.score_documents(spark.createDataFrame(only_held_out, "doc_id bigint, text string")).collect()
    assert {(r.held_out, r.n_known, r.train_tokens, round(abs(r.base_score), 9)) for r in got} == {(True, 0, 0, 0.0)}
    assert lm.score_documents(spark.createDataFrame([], schema)).count() == 0


def test_every_training_document_is_learned_from(spark):
    """Documents of each eighth of the hash alone change the weights."""
    share = lambda k: zlib.crc32(str(k).encode()) // 5 % 8
    for r in range(8):
        keys = [k for k in range(400) if zlib.crc32(str(k).encode()) % 5 != 1 and share(k) == r][:3]
        docs = spark.createDataFrame([(k, "to be or not to be " * 9) for k in keys], "doc_id bigint, text string").coalesce(1)
        before, after = (lm.flat(lm.fit(docs, rounds=n)[0].weights) for n in (0, lm.ROUNDS))
        assert not np.array_equal(before, after), r


def test_symbols_grow_with_the_vocabulary(spark):
    """Every word that occurs often enough has a symbol of its own; classes are about the root of the symbols."""
    for v in (300, 2_000):
        docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(v))) for k in range(30)], "doc_id bigint, text string").coalesce(2)
        model, _ = lm.fit(docs, rounds=1)
        assert len(model.words) == v + 1 and len(set(model.symbols.tolist())) == v + 1 and model.other not in model.symbols
        assert 0.5 * v**0.5 <= len(model.shape.start) - 1 <= 2 * v**0.5


def test_symbols_grow_beyond_the_share_threshold(spark, monkeypatch):
    """The threshold grows with the root of the tokens, so that a word's needed share shrinks with the input."""
    monkeypatch.setattr(lm, "FREQUENT", 10)
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(200))) for k in range(30)], "doc_id bigint, text string")
    assert len(lm.fit(docs, rounds=0)[0].words) == 201


def test_tables_of_weights():
    w, _, _ = tiny(4)
    back = lm.from_table(lm.table_of(w), w)
    assert all(np.allclose(a, b) and a.shape == b.shape for a, b in zip(w, back))


def test_rows_of_a_place_are_added_in_order():
    """The sums by place equal numpy's one by one additions bit for bit, for places that come once and often."""
    rng = np.random.default_rng(8)
    for n in (1, 3, 40):
        place = np.concatenate([np.arange(n), rng.integers(0, n, 60), np.zeros(25, int)])
        values = rng.normal(size=(len(place), 5)).astype(np.float32)
        want = np.zeros((n, 5), np.float32)
        np.add.at(want, place, values)
        assert np.array_equal(lm._summed_by(place, values, n), want)


def test_classes_are_worked_on_together(monkeypatch):
    """The scores of many classes are raised at once, with the same likelihoods and gradients as class after class."""
    calls = []

    class Counted:
        def __getattr__(self, name):
            if name == "exp":
                calls.append(name)
            return getattr(np, name)

    w, shape, _ = tiny(6, symbols=160, classes=40, size=3)
    symbol = np.random.default_rng(9).integers(0, 160, 300)
    h = np.random.default_rng(10).normal(0, 1, (300, 3))
    runs = []
    monkeypatch.setattr(lm, "np", Counted())
    for together in (1 << 16, 0):
        monkeypatch.setattr(lm, "TOGETHER", together, raising=False)
        gradients = lm.Weights(*[np.zeros_like(x) for x in w])
        del calls[:]
        out, dh = lm.log_probabilities(w, shape, h, symbol, gradients)
        runs.append((len(calls), out, dh, gradients))
    assert runs[0][0] <= 6 and runs[1][0] > 40
    assert np.array_equal(runs[0][1], runs[1][1]) and np.array_equal(runs[0][2], runs[1][2])
    assert all(np.array_equal(a, b) for a, b in zip(runs[0][3], runs[1][3]))
