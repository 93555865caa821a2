"""Dictionary terms in messages against the whole-word pattern, term by term."""

import random
import re

from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import entities as E
from threadloom.plans.entities import graph_inputs


def test_terms_are_whole_words_whatever_stands_in_them(spark):
    terms = ["java", "next.js", ".net", "c++", "c", "spring boot", "gpt-4o", "a b c", "a.b", "f#", "+x+", "++", "é java", "b"]
    rng = random.Random(1)
    alphabet = ["java", "next", ".", "js", "net", "c", "+", "++", " ", " ", "\n", "spring", "boot", "a", "b", "f#", "x", "é", "-", "B.A"]
    texts = [(i, 0, "".join(rng.choices(alphabet, k=rng.randrange(0, 25)))) for i in range(400)]
    texts += [(900, 1, ".net"), (901, 1, "asp.net c++"), (902, 1, "C++x +x+"), (903, 1, None), (904, 2, "next.js NEXT.JS " * 20_000)]
    dictionary = spark.createDataFrame([(t, t.upper(), "tech", i) for i, t in enumerate(terms)], "term string, canonical string, type string, place int")
    got = E.term_mentions(spark.createDataFrame(texts, "conv_id bigint, turn int, full_text string"), dictionary)
    found = [(r["conv_id"], r["turn"], r["name"]) for r in got.collect()]
    want = set()
    for conv, turn, text in texts:
        for t in terms:
            if re.search("[a-z0-9_-]", t) and re.search(rf"(?<![a-zA-Z0-9_\-]){re.escape(t)}(?![a-zA-Z0-9_\-])", (text or "").lower()):
                want.add((conv, turn, t.upper()))
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 200
    assert E.term_mentions(spark.createDataFrame(texts, "conv_id bigint, turn int, full_text string"), dictionary.where("place < 0")).count() == 0


def _arguments(plan, function):
    """What stands between the parentheses of each call of a function in a plan's text."""
    for at in re.finditer(re.escape(function) + r"\(", plan):
        depth, end = 1, at.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(plan[end], 0)
            end += 1
        yield plan[at.end() : end - 1]


def test_repeats_in_a_message_are_left_out_in_linear_time(spark):
    """array_distinct compares structs pair by pair, texts by their hashes."""
    terms = ["java", "a b", "gpt-4o", None, ""]
    dictionary = spark.createDataFrame([(t, t and t.upper(), "tech", i) for i, t in enumerate(terms)], "term string, canonical string, type string, place int")
    many = " ".join(f"w{i}" for i in range(3000))
    texts = [(1, 0, "Java java JAVA a b, a b a  b"), (1, 0, "java"), (None, 1, "x gpt-4o a b"), (2, 0, None), (3, 0, ""), (4, None, many + " java " + many)]
    got = E.term_mentions(spark.createDataFrame(texts, "conv_id bigint, turn int, full_text string"), dictionary)
    rows = sorted(((r["conv_id"] or 0, r["turn"], r["key"]) for r in got.collect()), key=str)
    assert rows == sorted([(1, 0, "tech:java"), (1, 0, "tech:a b"), (1, 0, "tech:java"), (0, 1, "tech:gpt-4o"), (0, 1, "tech:a b"), (4, None, "tech:java")], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    distinct = list(_arguments(plan, "array_distinct"))
    assert distinct and not any("struct(" in x for x in distinct)


def test_content_words_are_looked_up_by_hash_and_keep_repeats(spark):
    rows = spark.createDataFrame([(["the", "fox", "and", "fox", ""],), ([],), (None,), (["the", None, "fox"],)], "w array<string>")
    out = rows.select(T.content_words(F.col("w")).alias("c"))
    assert [r["c"] for r in out.collect()] == [["fox", "fox", ""], [], None, ["fox"]]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "INSET" in plan and "array_contains" not in plan


def test_entities_and_their_resolution_are_written_once(spark, sf):
    """each reader of these tables made them again from the mentions."""
    for table in graph_inputs(spark, sf)[1:]:
        assert "Aggregate" not in table._jdf.queryExecution().optimizedPlan().toString()
        assert table.count() > 0
