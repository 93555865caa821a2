"""Column functions, ordered operations, substring joins, components and chains against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import chains, components, ordered, substrings
from threadloom.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def test_token_estimate(spark):
    assert one(spark, T.token_estimate(F.lit(""))) == 0
    assert one(spark, T.token_estimate(F.lit("hello"))) == 1
    assert one(spark, T.token_estimate(F.lit("x" * 41))) == 10


@pytest.mark.parametrize(
    "a,b,want",
    [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0], [1.0, 2.0], 0.0), ([], [], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0)],
)
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert abs(df.select(T.cosine(F.col("a"), F.col("b"))).first()[0] - want) < 1e-9


def test_recency(spark):
    assert one(spark, T.recency(F.lit(0.0), 30)) == 1.0
    assert one(spark, T.recency(F.lit(-1.0), 30)) == 1.0
    assert one(spark, T.recency(F.lit(10.0), 0)) == 1.0
    assert abs(one(spark, T.recency(F.lit(30.0), 30)) - 0.5) < 1e-9


def test_jaccard_guards(spark):
    empty, some = F.array().cast("array<string>"), F.array(F.lit("a"))
    assert one(spark, T.jaccard(empty, empty, both_empty=1.0)) == 1.0
    assert one(spark, T.jaccard(empty, some, both_empty=1.0)) == 0.0
    assert one(spark, T.jaccard(empty, empty)) == 0.0


def test_sentences_and_words(spark):
    assert one(spark, T.sentences(F.lit(" One. Two!\nThree? "))) == ["One.", "Two!", "Three?"]
    assert one(spark, T.words(F.lit("Don't stop_me, Ok2"))) == ["don", "t", "stop_me", "ok2"]


def test_truncate_artifact_cuts_at_a_late_newline(spark):
    late = "a" * 300 + "\n" + "b" * 200
    early = "a" * 50 + "\n" + "b" * 500
    assert one(spark, T.truncate_artifact(F.lit(late), 100)) == "a" * 300 + "\n... [truncated]"
    assert one(spark, T.truncate_artifact(F.lit(early), 100)) == (early[:400]) + "\n... [truncated]"


def test_snippet(spark):
    text = "x" * 100 + " needle " + "y" * 300
    got = one(spark, T.snippet(F.lit(text), F.array(F.lit("needle"), F.lit("zzz"))))
    assert got.startswith("...") and got.endswith("...") and "needle" in got


def test_url_and_blanks(spark):
    assert one(spark, T.conversation_url(F.lit("https://a/b?x=1#y"))) == "https://a/b"
    assert one(spark, T.squeeze_blanks(F.lit(" a\n\n\n\nb  \t c "))) == "a\n\nb c"


@pytest.fixture(scope="module")
def hot_rows(spark):
    """One key holds most rows, so its rows fall into many buckets."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.randrange(10)) for i in range(3000)]
    return spark.createDataFrame(rows, "k string, t bigint, v bigint")


def test_running_sum_equals_plain_window(hot_rows):
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    want = hot_rows.withColumn("s", F.sum("v").over(w))
    got = ordered.running_sum(hot_rows, ["k"], ["t"], F.col("v"), ordered.bucket_of("t", 64), "s")
    assert sorted(map(tuple, got.select("k", "t", "v", "s").collect())) == sorted(map(tuple, want.collect()))
    before = ordered.running_sum(hot_rows, ["k"], ["t"], F.col("v"), ordered.bucket_of("t", 64), "s", inclusive=False)
    assert before.where("s < 0").count() == 0 and before.agg(F.sum("s")).first()[0] == got.agg(F.sum(F.col("s") - F.col("v"))).first()[0]


@pytest.mark.parametrize("step", [1, -1])
def test_previous_equals_plain_window(hot_rows, step):
    w = Window.partitionBy("k").orderBy("t")
    fn = F.lag if step == 1 else F.lead
    want = hot_rows.withColumn("p", fn("v").over(w))
    got = ordered.previous(hot_rows, ["k"], ["t"], ["v"], ordered.bucket_of("t", 50), "x", step)
    got = got.select("k", "t", "v", F.col("x.v").alias("p"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_top_rows_is_partial_before_the_shuffle(hot_rows):
    top = ordered.top_rows(hot_rows, ["k"], [F.desc("v"), F.asc("t")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.where("k = 'hot'").count() == 3


def test_substring_join_equals_brute_force(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 14))) for _ in range(120)})
    df = spark.createDataFrame([(1, n) for n in names], "k int, text string")
    got = substrings.containing(df.withColumnRenamed("text", "needle"), df, ["k"], shortest=3)
    want = {(a, b) for a, b in itertools.permutations(names, 2) if len(a) >= 3 and a in b}
    assert {(r.needle, r.text) for r in got.collect()} == want


def test_components(spark):
    edges = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "x", "y"), (2, "a", "z")], "k int, a string, b string")
    got = {(r.k, r.node): r.component for r in components.connected(edges, ["k"]).collect()}
    assert got == {(1, "a"): "a", (1, "b"): "a", (1, "c"): "a", (1, "x"): "x", (1, "y"): "x", (2, "a"): "a", (2, "z"): "a"}


def test_walk_stops_at_ends_limits_and_cycles(spark):
    links = [(1, i, i + 1) for i in range(40)] + [(2, 0, 1), (2, 1, 2), (2, 2, 0)]
    df = spark.createDataFrame(links, "k int, node int, next int")
    starts = spark.createDataFrame([(1, 0), (2, 0)], "k int, start int")
    full = chains.walk(starts, df, ["k"])
    assert full.where("k = 1").count() == 41 and full.where("k = 1").agg(F.max("step")).first()[0] == 40
    assert sorted((r.node, r.step) for r in full.where("k = 2").collect()) == [(0, 0), (1, 1), (2, 2)]
    assert chains.walk(starts, df, ["k"], 9).where("k = 1").count() == 10
    assert {r.node for r in chains.leads_to_cycle(df, ["k"]).collect()} == {0, 1, 2}
