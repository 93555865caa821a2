"""Substring joins without comparing every needle with every text.

containing() cuts short texts into all their short substrings (grams).  A needle of at most GRAM characters occurs in the text
iff it equals one of them; a longer needle is looked up by its first GRAM characters and verified on the few texts found.

occurring() is for long texts and a dictionary of needles: each needle is registered under the rarest of its own grams, and a
text passes on only grams that the dictionary has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import saved

GRAM = 8
#: Grams of the dictionary; a shorter needle is its own gram.
KEY_GRAM = 4
#: The dictionary's distinct grams are sent to all tasks up to this number; beyond it the filter shuffles.
SENT_GRAMS = 500_000


def grams(texts: DataFrame, keys: Sequence[str], shortest: int = 1) -> DataFrame:
    """texts(keys, text) -> distinct (keys, text, gram) with grams of `shortest` to GRAM characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text") - (shortest - 1), F.lit(1)))
    placed = texts.select(*keys, "text", F.explode(starts).alias("at"))
    cut = F.transform(
        F.sequence(F.lit(shortest), F.lit(GRAM)), lambda n: F.substring(F.col("text"), F.col("at"), n)
    )
    rows = placed.select(*keys, "text", F.explode(F.array_distinct(cut)).alias("gram"))
    return rows.where(F.length("gram") >= shortest).distinct()


def containing(needles: DataFrame, texts: DataFrame, keys: Sequence[str], shortest: int = 1) -> DataFrame:
    """Pairs (keys, needle, text) where the text contains the needle and is not equal to it."""
    keys = list(keys)
    cut = grams(texts, keys, shortest)
    usable = needles.where(F.length("needle") >= shortest).withColumn("gram", F.substring("needle", 1, GRAM))
    # Both sides grow with the input: neither is collected for a broadcast.
    pairs = usable.join(cut.hint("merge"), [*keys, "gram"])
    inside = (F.length("needle") <= GRAM) | F.contains(F.col("text"), F.col("needle"))
    return pairs.where(inside & (F.col("needle") != F.col("text"))).select(*keys, "needle", "text").distinct()


def _all_grams(text, n: int):
    """Every substring of n characters, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def occurring(needles: DataFrame, texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """needles(keys, needle), texts(keys, text) -> distinct (keys, needle) that occur in a text of the same key.

    A needle equal to the text occurs in it; the empty needle occurs in every text.  Null texts and needles match nothing.
    """
    keys = list(keys)
    needles = saved(needles.where(F.col("needle").isNotNull()).select(*keys, "needle").distinct(), "needles")
    texts = texts.where(F.col("text").isNotNull()).select(*keys, "text").distinct()
    texts = texts.join(needles.select(*keys).distinct(), keys, "left_semi")
    length = F.char_length("needle")
    own = F.when(length < KEY_GRAM, F.array("needle")).otherwise(F.array_distinct(_all_grams(F.col("needle"), KEY_GRAM)))
    cut = needles.select(*keys, "needle", F.explode(own).alias("gram"))
    rarity = cut.groupBy("gram").agg(F.count("*").alias("names"))
    chosen = cut.join(rarity, "gram").groupBy(*keys, "needle").agg(F.min(F.struct("names", "gram")).alias("g"))
    chosen = saved(chosen.select(*keys, "needle", F.col("g.gram").alias("gram")), "dictionary")
    # At most KEY_GRAM different lengths.
    lengths = [r[0] for r in chosen.select(F.char_length("gram").alias("n")).distinct().collect()]
    found = needles.where(length == 0).join(texts.select(*keys).distinct(), keys, "left_semi")
    lengths = sorted(n for n in lengths if n)
    if not lengths:
        return found
    known = saved(chosen.select("gram").distinct(), "grams")
    known = F.broadcast(known) if known.count() <= SENT_GRAMS else known
    marked = texts.withColumn("text_id", F.xxhash64("text"))
    grams_of = F.array_distinct(F.concat(*(_all_grams(F.col("text"), n) for n in lengths)))
    held = marked.select(*keys, "text_id", F.explode(grams_of).alias("gram")).join(known, "gram", "left_semi")
    met = saved(held.join(chosen, [*keys, "gram"]).select(*keys, "needle", "text_id"), "met")
    short = met.where(length <= KEY_GRAM).select(*keys, "needle")
    # Two texts of one hash are both looked at.
    long = met.where(length > KEY_GRAM).join(marked, [*keys, "text_id"]).where(F.contains("text", "needle")).select(*keys, "needle")
    return found.unionByName(short).unionByName(long).distinct()
