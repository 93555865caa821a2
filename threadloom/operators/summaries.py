"""Topic segmentation and three-level extractive summaries, per conversation.

Input everywhere: messages(conv_id, turn, full_text, ...).  Nothing groups a whole conversation into one task: sentence
statistics are hash aggregates on (scope, token), top sentences are bounded by a partial group limit, and the ordered
steps of the segmentation use the bucketed operations of `functions.ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions import ordered
from threadloom.functions import text as T
from threadloom.session import saved

SHORT_MESSAGE = 50
TOPIC_SENTENCES = 5
GLOBAL_SENTENCES = 10
GLOBAL_WORDS = 200
TOPIC_SIMILARITY = 0.15
TURN_BUCKET = 1024


def sentence_table(messages: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """One row per sentence with its word count and its content words (stop words out, repeats kept)."""
    exploded = messages.select("conv_id", "turn", *carry, F.posexplode(T.sentences("full_text")).alias("pos", "sentence"))
    tokens = T.words("sentence")
    return exploded.withColumn("__tokens", tokens).select(
        "conv_id",
        "turn",
        *carry,
        "pos",
        "sentence",
        F.size("__tokens").alias("n_words"),
        T.content_words(F.col("__tokens")).alias("content"),
    )


def sentence_idf(sentences: DataFrame, scope: Sequence[str] = ("conv_id",)) -> DataFrame:
    """ln((N + 1) / (df + 1)) + 1 per token, where N and df count the sentences of the scope."""
    n = sentences.groupBy(*scope).agg(F.count("*").alias("n"))
    df = (
        sentences.select(*scope, F.explode(F.array_distinct("content")).alias("token"))
        .groupBy(*scope, "token")
        .agg(F.count("*").alias("df"))
    )
    idf = F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return df.join(n, list(scope)).select(*scope, "token", "df", idf.alias("idf"))


def score_sentences(sentences: DataFrame, scope: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Add `score`: the sum of idf over the content words of a sentence divided by all its words (rounded to 6)."""
    scope = list(scope)
    key = [*scope, "turn", "pos"] if "turn" not in scope else [*scope, "pos"]
    occurrences = sentences.select(*key, "n_words", F.explode("content").alias("token"))
    weights = sentence_idf(sentences, scope).select(*scope, "token", "idf")
    scores = (
        occurrences.join(weights, [*scope, "token"])
        .groupBy(*key)
        .agg((F.sum("idf") / F.first("n_words")).alias("score"))
    )
    # Sentences without content words have no row in `scores`; the outer join gives them 0.
    return sentences.join(scores, key, "left").withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 6))


def summary_row(level: str, content, low, high):
    return [
        F.lit(level).alias("level"),
        content.alias("content"),
        F.size(T.words(content)).alias("token_count"),
        low.cast("bigint").alias("first_turn"),
        high.cast("bigint").alias("last_turn"),
    ]


def message_summaries(messages: DataFrame, scored: DataFrame) -> DataFrame:
    """Short messages verbatim, otherwise the best sentence (earliest on ties)."""
    # max_by keeps one candidate per message in the map-side aggregate; no sort, no window.
    best = scored.groupBy("conv_id", "turn").agg(
        F.max_by("sentence", F.struct(F.col("score"), -F.col("pos"))).alias("best")
    )
    body = T.strip("full_text")
    content = F.when(F.length(body) <= SHORT_MESSAGE, body).otherwise(F.coalesce("best", F.substring(body, 1, 200)))
    kept = messages.where(body != "").join(best, ["conv_id", "turn"], "left").withColumn("__content", content)
    return kept.select("conv_id", *summary_row("message", F.col("__content"), F.col("turn"), F.col("turn")))


def segment_topics(messages: DataFrame, threshold: float = TOPIC_SIMILARITY) -> DataFrame:
    """Add `keywords` and `segment`: a new segment starts where the overlap with the previous message is low."""
    marked = messages.withColumn("keywords", T.keywords("full_text"))
    bucket = ordered.bucket_of("turn", TURN_BUCKET)
    paired = ordered.previous(marked, ["conv_id"], ["turn"], ["keywords"], bucket, "before")
    similar = T.jaccard(F.col("before.keywords"), F.col("keywords"), both_empty=1.0) >= threshold
    starts = F.when(F.col("before").isNotNull() & similar, 0).otherwise(1)
    flagged = paired.withColumn("starts", starts).drop("before")
    numbered = ordered.running_sum(flagged, ["conv_id"], ["turn"], F.col("starts"), bucket, "segment")
    return numbered.withColumn("segment", (F.col("segment") - 1).cast("bigint")).drop("starts")


def merge_small_segments(segmented: DataFrame, min_size: int = 1) -> DataFrame:
    """Add `topic`: segments below the minimum size join the kept segment before them; the first one always stays."""
    if min_size <= 1:
        return segmented.withColumn("topic", F.col("segment")).withColumn("is_core", F.lit(True))
    sizes = segmented.groupBy("conv_id", "segment").agg(F.count("*").alias("size"))
    kept = F.when((F.col("size") >= min_size) | (F.col("segment") == 0), 1).otherwise(0)
    bucket = ordered.bucket_of("segment", TURN_BUCKET)
    ids = ordered.running_sum(sizes.withColumn("kept", kept), ["conv_id"], ["segment"], F.col("kept"), bucket, "topic")
    ids = ids.select("conv_id", "segment", (F.col("topic") - 1).cast("bigint").alias("topic"), (F.col("kept") == 1).alias("is_core"))
    return segmented.join(ids, ["conv_id", "segment"])


def topic_labels(topics: DataFrame) -> DataFrame:
    """Per topic: label from the three most frequent keywords of its core segment, message count and extent."""
    counted = (
        topics.where("is_core")
        .select("conv_id", "topic", F.explode("keywords").alias("word"))
        .groupBy("conv_id", "topic", "word")
        .agg(F.count("*").alias("n"))
    )
    top = ordered.top_rows(counted, ["conv_id", "topic"], [F.desc("n"), F.asc("word")], 3)
    words = top.groupBy("conv_id", "topic").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("top"))
    extent = topics.groupBy("conv_id", "topic").agg(
        F.count("*").alias("messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn")
    )
    label = F.coalesce(F.array_join("top.word", ", "), F.lit("General"))
    return extent.join(words, ["conv_id", "topic"], "left").withColumn("label", label).drop("top")


def topic_summaries(topics: DataFrame, sentences: DataFrame | None = None) -> DataFrame:
    """Up to five best sentences per topic, scored within the topic, in score order.

    With the sentence table at hand only the narrow topic numbers are joined to it; texts are not split again.
    """
    if sentences is None:
        placed = sentence_table(topics, ["topic"])
    else:
        placed = sentences.join(topics.select("conv_id", "turn", "topic"), ["conv_id", "turn"])
    scored = score_sentences(placed, ["conv_id", "topic"])
    order = [F.desc("score"), F.asc("turn"), F.asc("pos")]
    top = ordered.top_rows(scored, ["conv_id", "topic"], order, TOPIC_SENTENCES)
    text = top.groupBy("conv_id", "topic").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("rank", "sentence")))["sentence"], " ").alias("__content")
    )
    extent = topics.groupBy("conv_id", "topic").agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    joined = text.join(extent, ["conv_id", "topic"])
    return joined.select("conv_id", "topic", *summary_row("topic", F.col("__content"), F.col("low"), F.col("high")))


def global_sentences(scored: DataFrame) -> DataFrame:
    """The sentences of the global summary: best first until 200 words or ten sentences, the first one always."""
    order = [F.desc("score"), F.asc("turn"), F.asc("pos")]
    top = ordered.top_rows(scored, ["conv_id"], order, GLOBAL_SENTENCES)
    # At most ten rows per conversation are left, so this window is bounded whatever the conversation's size.
    upto = Window.partitionBy("conv_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    summed = top.withColumn("words_so_far", F.sum("n_words").over(upto))
    return summed.where((F.col("words_so_far") <= GLOBAL_WORDS) | (F.col("rank") == 1))


def global_summaries(messages: DataFrame, scored: DataFrame) -> DataFrame:
    chosen = global_sentences(scored)
    text = chosen.groupBy("conv_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("rank", "sentence")))["sentence"], " ").alias("__content")
    )
    size = messages.groupBy("conv_id").agg(F.count("*").alias("n"))
    joined = text.join(size, "conv_id")
    return joined.select("conv_id", *summary_row("global", F.col("__content"), F.lit(0), F.col("n") - 1))


def all_summaries(messages: DataFrame, min_topic_size: int = 1) -> DataFrame:
    """Message, topic and global summaries of every conversation in one table."""
    # Sentences, scores and topic numbers are each read several times: they are written once.
    sentences = saved(sentence_table(messages), "sentences")
    scored = saved(score_sentences(sentences).drop("content"), "scored")
    topics = merge_small_segments(segment_topics(messages), min_topic_size)
    topics = saved(topics.select("conv_id", "turn", "topic"), "topics")
    return (
        message_summaries(messages, scored)
        .unionByName(topic_summaries(topics, sentences).drop("topic"))
        .unionByName(global_summaries(messages, scored))
    )


def summary_stats(summaries: DataFrame) -> DataFrame:
    return summaries.groupBy("conv_id").agg(
        *[F.count_if(F.col("level") == v).alias(f"{v}_summaries") for v in ("message", "topic", "global")],
        F.sum("token_count").alias("summary_tokens"),
    )
