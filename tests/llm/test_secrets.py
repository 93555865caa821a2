"""Secret spans: fixed patterns, tokens, gradients and decoding against plain versions; held-out finds; unusual rows."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import secret_crf as S


def plain_base(text):
    """The contract's patterns on code points."""
    found = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.IGNORECASE | re.ASCII) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(S.KINDS[k], a, b) for a, k, b in sorted(found)]


def planted(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choices("abcdeñ", k=rng.randrange(1, 8))) for _ in range(60)]
        if i % 3 == 0:
            words.insert(rng.randrange(60), f'token = "{rng.randbytes(20).hex()}"')
        if i % 3 == 1:
            words.insert(rng.randrange(60), "key AKIA" + "".join(rng.choices("ABCDEFGH0123", k=16)))
        rows.append((i, " ".join(words), f"s{i % 4}", "en"))
    return rows


ODD = [
    (9001, None, None, None),
    (9002, "", "s", "en"),
    (9003, " \n\t ", "s", "en"),
    (9004, "PassWd: 'abc' ſecret=abcdefgh toKen=abcdefgh API_KEY='äb' apikey=a.b-c_d secret token=longenough password==abcdef", "s", "en"),
    (9005, "AKIA1234 AKIAAKIA" + "Z" * 30 + " éé" + "0123456789abcdef" * 3 + "ABCDEF" + "f" * 24 + "g", "s", "en"),
    (9006, "x " * 60_000 + 'secret: "' + "deadbeef" * 9 + '"' + " é" * 20_000, "s", "en"),
    (9007, "f" * 100_000, "s", "en"),
    (None, "token=abcdefg", "s", "en"),
    (9004, "token=abcdefg", "s", "en"),
    (9004, "token=abcdefg", "s", "en"),
]
SCHEMA = "doc_id bigint, text string, source string, lang string"


def test_base_spans_and_rows(spark):
    rows = planted(30) + ODD
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", spans string, kind int")
    got = S.secret_spans(docs).collect()
    assert len(got) == len(rows)
    key = lambda x: (str(x[0]), x[1])
    base = [(r["doc_id"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "crf"]) for r in got]
    assert sorted(base, key=key) == sorted(((i, plain_base(t or "")) for i, t, *_ in rows), key=key)
    texts = {i: t for i, t, *_ in rows}
    for r in got:
        spans = [(s["start"], S.KINDS.index(s["kind"]), s["end"]) for s in r["spans"]]
        assert spans == sorted(spans) and all(0 <= a < b <= len(texts[r["doc_id"]] or "") or r["doc_id"] == 9004 for a, _, b in spans)
        fixed = [s for s in spans if s[1] < 3]
        assert not any(a < f and e < b for a, k, b in spans if k == 3 for e, _, f in fixed)


def test_empty_table(spark):
    assert S.secret_spans(spark.createDataFrame([], SCHEMA)).collect() == []
    assert S.secret_spans(spark.createDataFrame([(1, "nothing here")], "doc_id bigint, text string")).first()["spans"] == []


def test_tokens_are_runs_and_marks():
    texts = ["ab1-c: 'é_x' \n", "", "a", "b==" , "   "]
    t = S.tokens_of(pa.array([x.encode() for x in texts], pa.large_binary()))
    for i, text in enumerate(texts):
        want = re.findall(r"(?a:[A-Za-z0-9+/_-]|[^\x00-\x7f])+|[^\s]", text)
        assert [t.distinct[k].decode() for k in t.which[t.first[i] : t.first[i + 1]]] == want


def random_field(rng, size=40):
    return S.Field(rng.normal(size=(size, 2)), rng.normal(size=(3, 3)))


def test_gradients_against_differences_and_enumeration():
    rng = np.random.default_rng(0)
    field = random_field(rng)
    features, tags = rng.integers(0, 40, (4, 5, 3)), rng.integers(0, 3, (4, 5))
    tags[1, 3:] = tags[2, 1:] = -1
    value, dw, dp = S.likelihood(field, features, tags)

    def path(x, y):
        s = np.concatenate([np.zeros((5, 1)), field.weights[x].sum(axis=1)], axis=1)
        return sum(field.pairs[a, b] + s[i, b] for i, (a, b) in enumerate(zip([0, *y], y)))

    plain = 0
    for x, y in zip(features, tags):
        n = int((y >= 0).sum())
        plain += path(x, y[:n]) - np.log(sum(np.exp(path(x, z)) for z in itertools.product(range(3), repeat=n)))
    assert value == pytest.approx(plain / 4)
    for array, gradient in ((field.weights, dw), (field.pairs, dp)):
        for at in [(1, 1), (2, 0), (0, 1)]:
            kept = array[at]
            array[at] = kept + 1e-5
            up = S.likelihood(field, features, tags)[0]
            array[at] = kept - 1e-5
            down = S.likelihood(field, features, tags)[0]
            array[at] = kept
            assert gradient[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_decoding_of_whole_texts_is_exact():
    """Cutting at certain tokens gives what Viterbi gives over each text as one chain."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["a", "bc", "D4", "=", "e5f6", "ü"], n)) for n in (0, 1, 3, 200, 40, 7)]
    field = S.Field(rng.normal(size=(S.BUCKETS, 2)) - 0.12, rng.normal(size=(3, 3)))
    t = S.tokens_of(pa.array([x.encode() for x in texts], pa.large_binary()))
    memory = S._Memory(field)
    got = S.tag(field, memory, t, np.zeros((len(texts), 2)))
    some = 0
    for i, text in enumerate(texts):
        words = text.encode().split()
        f = S.token_features([b"", *words])
        n = len(words)
        score = np.zeros((n, 3))
        for k in range(n):
            rows = [*f[k + 1, :8], *f[k, 8:10], *f[max(0, k - 1), 10:11], *f[k + 2 if k + 1 < n else 0, 11:13]]
            score[k, 1:] = field.weights[rows].sum(axis=0)
        tags = S.viterbi(score, field.pairs) if n else []
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        spans, at = [], None
        for k, y in enumerate([*tags, 0]):
            if at is not None and y != S.INSIDE:
                spans.append((int(ends[at] - len(words[at])), int(ends[k - 1])))
                at = None
            if y == S.BEGIN or (y == S.INSIDE and at is None):
                at = k
        assert got[i] == spans
        some += len(spans)
    assert 10 < some < 200


def test_held_out_finds_and_other_dresses(spark):
    """The field, without the patterns, tags what they find in documents it never saw, and leaves plain ones alone."""
    rows = planted(600, 2)
    field = S.train(spark.createDataFrame(rows, SCHEMA))
    hits = finds = false = plain = 0
    for i, text, source, lang in rows:
        if zlib.crc32(str(i).encode()) % 5 != S.HELD_OUT:
            continue
        data = pa.array([text.encode()], pa.large_binary())
        about = field.weights[S.file_features([source], [lang], [len(text.encode())])].sum(axis=1)
        (added,) = S.tag(field, S._Memory(field), S.tokens_of(data), about)
        base = S.base_spans(text.encode())
        finds += len(base)
        hits += sum(any(a < e and s < b for a, b in added) for s, e, _ in base)
        if not base:
            plain += 1
            false += bool(added)
    assert finds > 40 and hits >= 0.95 * finds and plain > 20 and false <= 0.05 * plain
    docs = spark.createDataFrame([(1, 'abc dec key "' + "4f9a7c01e2" * 2 + '" bad cab', "s1", "en")], SCHEMA)
    assert [s["kind"] for s in S.secret_spans(docs, field).first()["spans"]] in (["crf"], [])
