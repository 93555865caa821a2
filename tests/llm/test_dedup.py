"""Similarity join, suffix and sentence-span deduplication against brute force, on small and unusual tables."""

import collections
import hashlib
import random

import numpy as np
import pytest

from threadloom.llm import graph, ngram_join, sentence_spans, suffix_dedup

DOCS = "doc_id bigint, text string, n_bytes string, node string"


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def near_copies(seed):
    """Base texts with copies, edited copies, short sets and shared passages."""
    rng = random.Random(seed)
    passage = words(rng, 30)
    out = []
    for size in (1, 2, 3, 8, 12, 13, 14, 15, 22, 23, 33, 60, 200):
        base = words(rng, size)
        out += [base, base[:-1] or base, base + ["tail"], base[1:] or base]
        for _ in range(6):
            copy = list(base)
            copy[rng.randrange(size)] = "edit"
            out.append(copy)
        out.append(base + passage)
    for _ in range(25):  # a group of near copies without a common original
        copy = words(random.Random(1), 300)
        for _ in range(4):
            copy[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        out.append(copy)
    texts = [" ".join(x).upper() if i % 3 else "\n ".join(x) for i, x in enumerate(out)]
    rows = [(i, t, "", "") for i, t in enumerate(texts)] + [(900, "", "", ""), (901, None, "", ""), (902, " \n", None, None), (3, texts[3], "", "")]
    return rows + [(None, texts[0], "", "")]


def brute_components(rows, width, percent):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[find(i)].append(row[0])
    return sorted(((r[0], len(s), min(least[find(i)]) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


@pytest.mark.parametrize(("width", "percent", "seed"), [(3, 90, 1), (5, 80, 2)])
def test_components_equal_brute_force(spark, width, percent, seed):
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = ngram_join.jaccard_components(docs, width=width, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, width, percent)


def test_join_of_an_empty_table(spark):
    empty = spark.createDataFrame([], DOCS)
    assert ngram_join.jaccard_components(empty).collect() == []
    assert ngram_join.jaccard_components(spark.createDataFrame([(1, None, "", "")], DOCS)).collect()[0].component_id == 1


def test_join_without_sent_sides(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "sent_if_small", lambda side: side.hint("merge"))
    rows = near_copies(7)[:60]
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows, 3, 90)


def test_boundary_follows_the_sizes():
    assert ngram_join.best_boundary({40: 1_000}, 90) < 40
    assert ngram_join.best_boundary({12: 1_000, 50: 1}, 90) >= 12
    assert ngram_join.allowed(10, 90) == 1 and ngram_join.allowed(9, 90) == 0 and ngram_join.subset_count(20, 90) == 1 + 20 + 190


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    bits = lambda x: int(np.unpackbits(x.view(np.uint8)).sum())
    for n in (0, 1, 40, 300, 3_000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False))
        for lost in (0, 1, n // 20, n // 2, n):
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2**64, lost, np.uint64, endpoint=False)]))
            apart = bits(ngram_join.parities(a) ^ ngram_join.parities(b))
            assert apart <= len(np.setxor1d(a, b)) and apart % 2 == len(np.setxor1d(a, b)) % 2


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_linked_sets_list_a_common_part(percent):
    rng = np.random.default_rng(percent)
    draw = lambda n: np.unique(rng.integers(0, 2**64, n, np.uint64, endpoint=False))
    often = draw(60)
    rank = rng.integers(1, 50, len(often))
    for n in [1, 2, 5, 9, 10, 11, 40, 41, 150, 700] * 6:
        a = np.unique(np.concatenate([draw(n), rng.choice(often, min(n, 30))]))
        # Lose and gain shingles while the sets stay linked.
        lost = 0
        while True:
            b = np.union1d(a[lost + 1 :], draw((lost + 1) * (n % 2)))
            if not len(b) or not ngram_join.linked(a, b, percent):
                break
            lost += 1
        b = np.union1d(a[lost:], draw(lost * (n % 2)))
        if not ngram_join.linked(a, b, percent):
            continue
        small, large = sorted((a, b), key=len)
        own = ngram_join._parts(small, often, rank, percent)[0]
        assert np.isin(own, np.concatenate(ngram_join._parts(large, often, rank, percent))).any()


def test_sets_with_a_tenth_in_common_do_not_meet():
    rng = np.random.default_rng(1)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    shared = rng.integers(0, 2**64, 30, np.uint64, endpoint=False)
    for _ in range(20):
        a, b = (np.concatenate(ngram_join._parts(np.union1d(shared, rng.integers(0, 2**64, 270, np.uint64, endpoint=False)), *none, 90)) for _ in range(2))
        assert not len(np.intersect1d(a, b))


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7), (1001, 1000)]
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len({roots[i] for i in range(301)}) == 1
    assert roots[1000] == roots[1001] != roots[0]
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_removed(texts, length=200):
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = int(gone[0]) + int(np.sum(gone[1:] & ~gone[:-1])) if len(t) else 0
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings_equal_brute_force(spark):
    rng = random.Random(4)
    letters = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    shared, tiny = letters(450), letters(199)
    texts = [letters(900) for _ in range(6)]
    texts += [letters(100) + shared + letters(50), shared + letters(300), letters(10) + shared[:230], shared[100:350], tiny, tiny, "", None, shared, shared]
    texts += ["a" * 700, letters(50) + "ab" * 400, letters(20) + shared[:300] + "X" + shared[301:], letters(300) + texts[0][100:301] + texts[0][50:260]]
    texts += [shared[:225] + letters(1) + shared[226:] for _ in range(30)]
    ids = [None if i == 2 else i // 2 for i in range(len(texts))]  # keys are only handed on
    rows = [(k, t, "", "") for k, t in zip(ids, texts)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    want = [(k, *x) for k, x in zip(ids, brute_removed([(t or "").encode() for t in texts]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert suffix_dedup.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


def test_ranges_cover_every_start_across_segments(monkeypatch):
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 5_000, np.uint8).tobytes()
    whole = suffix_dedup.ranges_of(text)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 700)
    cut = suffix_dedup.ranges_of(text)
    for r in (whole, cut):
        assert r.low[0] == 0 and r.high[-1] == 4_800 and (r.low[1:] == r.high[:-1] + 1).all()
    spread = lambda r: np.repeat(r.name, r.high - r.low + 1)
    assert (spread(whole) == spread(cut)).all()


def brute_spans(rows):
    """Every shortest sufficient run, forwards and backwards; the first is in the document of the smallest key."""
    first, units = {}, {}
    for key, text in rows:
        u = sentence_spans.units_of((text or "").encode())
        body = (text or "").encode().lower()
        ends = [*u.starts[1:], len(body)]
        units[key] = ([tuple(body[s:e].split()) for s, e in zip(u.starts, ends)], u)
    found = {}
    for key in sorted(units):
        us = units[key][0]
        mine = set()
        for i in range(len(us)):
            for j in range(i + 2, len(us) + 1):
                if sum(map(len, us[i:j])) >= sentence_spans.MIN_WORDS:
                    mine.add((i, j))
                    break
        for j in range(len(us), 0, -1):
            for i in range(j - 2, -1, -1):
                if sum(map(len, us[i:j])) >= sentence_spans.MIN_WORDS:
                    mine.add((i, j))
                    break
        for i, j in sorted(mine):
            first.setdefault(tuple(us[i:j]), (key, i))
        found[key] = mine
    out = {}
    for key, text in rows:
        us, u = units[key]
        gone = {k for i, j in found[key] if first[tuple(us[i:j])] != (key, i) for k in range(i, j)}
        raw = (text or "").encode()
        ends = [*u.starts[1:], len(raw)]
        out[key] = (b"".join(raw[s:e] for k, (s, e) in enumerate(zip(u.starts, ends)) if k not in gone) if us else raw, len(us), len(gone))
    return out


def test_sentence_spans_equal_brute_force(spark):
    rng = random.Random(8)
    sentence = lambda n: " ".join(words(rng, n, 5_000)).capitalize() + rng.choice(".!?")
    passage = [sentence(rng.randint(2, 30)) for _ in range(6)]
    texts = []
    for _ in range(12):
        own = [sentence(rng.randint(1, 40)) for _ in range(rng.randint(0, 6))]
        at = rng.randint(0, len(own))
        part = passage[rng.randint(0, 2) : rng.randint(3, 6)]
        texts.append(rng.choice([" ", "\n", "  \n"]).join(own[:at] + part + own[at:] + part * rng.randint(0, 1)))
    texts += [texts[0], " " + texts[1].upper(), "", "no end", "   ", None, "A. B. C. A. B. C."]
    rows = list(enumerate(texts))
    got = sentence_spans.deduplicate(spark.createDataFrame([(k, t, "", "") for k, t in rows], DOCS).repartition(3)).collect()
    want = brute_spans(rows)
    assert {r.doc_id: ((r.text or "").encode(), r.n_units, r.n_removed) for r in got} == want
    assert [r.text for r in got if r.doc_id == len(texts) - 2] == [None]


def test_sentence_spans_of_unusual_rows(spark):
    long = "One two three four five six seven. Eight nine ten eleven twelve. Thirteen fourteen fifteen sixteen seventeen. " * 2
    rows = [(1, long, "a", "b"), (1, long, "a", "b"), (None, long, "a", "b"), (2, long, "a", "b")]
    got = sentence_spans.deduplicate(spark.createDataFrame(rows, DOCS)).collect()
    kept = collections.Counter((r.doc_id, r.n_removed > r.n_units // 2) for r in got)
    assert kept == {(1, False): 2, (None, True): 1, (2, True): 1}
    assert set(got[0].asDict()) == {"doc_id", "text", "n_bytes", "node", "n_units", "n_removed"}
    assert sentence_spans.deduplicate(spark.createDataFrame([], DOCS)).count() == 0


def test_passages_inside_long_sentences_are_found_at_any_offset(spark):
    """Passages of 51 words and more in the middle of sentences, at shifted offsets; no 51 words of a later one stay."""
    rng = random.Random(12)
    fresh = iter(range(10**6))
    own = lambda n: [f"own{next(fresh)}" for _ in range(n)]
    rows, passages = [], []
    for p in range(40):
        passage = [f"p{p}w{i}" + ("." if p % 2 and rng.random() < 0.07 else "") for i in range(rng.randint(51, 80))]
        passages.append(passage)
        for copy in range(2):
            rows.append((2 * p + copy, " ".join(own(rng.randint(1, 60)) + passage + own(rng.randint(1, 60)))))
    got = {r.doc_id: r.text.split() for r in sentence_spans.deduplicate(spark.createDataFrame([(*r, "", "") for r in rows], DOCS)).collect()}
    for p, passage in enumerate(passages):
        assert got[2 * p] == rows[2 * p][1].split()
        assert set(w for w in rows[2 * p + 1][1].split() if w.startswith("own")) <= set(got[2 * p + 1])
        left = [w for w in got[2 * p + 1] if w in set(passage)]
        assert len(left) < 2 * sentence_spans.PIECE_WORDS, (p, left)


def test_a_name_with_many_ranges_is_not_compared_in_one_task(spark, monkeypatch):
    """A passage in many documents with differing contexts, some of them repeated: right results, and no long list of one name."""
    rng = random.Random(21)
    letters = lambda n: "".join(rng.choice("abcdefgh \n") for _ in range(n))
    hot, near = letters(150), [letters(60) for _ in range(4)]
    texts = [letters(120) + rng.choice([letters(60), *near]) + hot + rng.choice([letters(60), *near]) + letters(120) for _ in range(60)]
    monkeypatch.setattr(suffix_dedup, "MANY", 5)
    merge = suffix_dedup._merge

    def short(batches):
        names = collections.Counter()

        def counted():
            for batch in batches:
                names.update(batch.column("name").to_pylist())
                assert max(names.values(), default=0) <= 5
                yield batch

        yield from merge(counted())

    monkeypatch.setattr(suffix_dedup, "_merge", short)
    rows = [(k, t, "", "") for k, t in enumerate(texts)]
    got = suffix_dedup.deduplicate(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    want = [(k, *x) for k, x in enumerate(brute_removed([t.encode() for t in texts]))]
    assert sorted(map(tuple, got)) == want and any(x[2] for x in want)
