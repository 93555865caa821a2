"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from threadloom.llm import spelling_variants


def within_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, min_length, min_count):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    near = {w: [x for x in n if within_one(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return out


def found(spark, rows, min_length, min_count):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, word string, n int")
    got = spelling_variants.spelling_variants(docs, min_length, min_count).select("word", "n", "n_near", "form", "form_n", "root")
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_random_words(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    rows = [(i, ", ".join(rng.choices(pool, k=40)).upper() if i % 4 else " ".join(rng.choices(pool, k=40))) for i in range(60)]
    rows += [(None, "abababa abababb ABABABA"), (7, None), (8, ""), (9, "--- 12"), (3, rows[3][1]), (3, rows[3][1])]
    for least, count in ((1, 1), (5, 3)):
        assert found(spark, rows, least, count) == brute(rows, least, count)


def test_chains_ties_and_long_texts(spark):
    # color <- colour's variants of growing frequency form a chain; two equally frequent neighbours; a word of 5,000 letters.
    words = ["abcdex"] * 3 + ["abcdef"] * 6 + ["abcdeg"] * 6 + ["abcdgg"] * 12 + ["bbcdgg"] * 24 + ["q" * 5000] * 3 + ["q" * 5001] * 6
    rows = [(1, " ".join(words)), (2, "×bcde ÷bcde xbcde " * 9), (3, "mot×É " * 30000)]
    assert found(spark, rows, 5, 3) == brute(rows, 5, 3)


def test_empty_table(spark):
    assert found(spark, [], 5, 3) == set()
    assert found(spark, [(1, None)], 5, 3) == set()


def test_counts_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    frequent = brute(rows, 6, 12)
    assert found(spark, rows, 6, 12) == frequent
