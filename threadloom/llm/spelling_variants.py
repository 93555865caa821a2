"""Spelling variants: the words of a corpus, which of them are one edit apart, and the frequent form each of them stands for.

Pairs are found by asymmetric q-chunks on two levels.  The shorter word of a pair (either one, at equal lengths) contributes
two disjoint chunks, its halves; one edit leaves one of them whole.  The edit then lies in the other half, whose two disjoint
quarters are chunks again, and one of those is whole too.  A key is one whole half with one whole quarter, so about three
quarters of a word agree before two words are compared.  The longer word contributes positional grams: before the edit a
chunk stands at its own place, behind it shifted by the difference of the lengths, nought or one; of all positional grams only
those at places within that shift can meet a chunk, and only they are made.  Keys are hashes: every meeting is verified by the
edit distance inside the join, so that only true pairs leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import saved

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
RUN = "[a-zÀ-ÿ]+"
#: A run loses one code point when this number divides its checksum.
EDIT_EVERY = 97
MIN_LENGTH = 5
MIN_COUNT = 3
#: A form has to be so many times as frequent as the word.
FACTOR = 2


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, edit_every: int = EDIT_EVERY) -> DataFrame:
    """docs(doc_id, text) -> (word, n): how often each word occurs in all texts, after the planted edits.

    A null text has no words; a null id counts as an empty one in the checksum.  Repeated rows count again.  Occurrences are
    counted inside the scan tasks before they are shuffled, so a word that every document has is one row per task.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(_lower(F.col("text")), F.lit(RUN), 0)).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % edit_every == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _keys(length: Column, shift: int) -> Column:
    """The keys of a word against chunk words of `length` code points, which is its own length less `shift`.

    Halves and quarters are placed by the chunk word's length; what lies behind the edit is read `shift` further on.
    """
    half, rest = F.floor(length / 2).cast("int"), (length - F.floor(length / 2)).cast("int")
    front, back = F.floor(rest / 2).cast("int"), F.floor(half / 2).cast("int")

    def piece(start: Column, size: Column) -> Column:
        return F.substr("word", start + 1, size)

    zero = F.lit(0)
    keys = [
        # The edit is in the second half: the first one is whole, and so is the start or the end of the second one.
        (piece(zero, half), piece(half, front)),
        (piece(zero, half), piece(length - front + shift, front)),
        # The edit is in the first half: the second one is whole but shifted.
        (piece(half + shift, rest), piece(zero, back)),
        (piece(half + shift, rest), piece(half - back + shift, back)),
    ]
    return F.array(*(F.xxhash64(length, F.lit(i), chunk, part) for i, (chunk, part) in enumerate(keys)))


def near_pairs(words: DataFrame) -> DataFrame:
    """words(word, n), each word once -> (a, n_a, b, n_b): pairs one inserted, deleted or replaced code point apart, each once.

    Words of any length are compared, also those of one code point (their chunks are empty).
    """
    length = F.char_length("word")
    chunks = words.select(F.explode(_keys(length, 0)).alias("key"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    grams = words.select(F.explode(F.concat(_keys(length, 0), _keys(length - 1, 1))).alias("key"), F.col("word").alias("b"), F.col("n").alias("n_b"))
    shorter = F.char_length("a") < F.char_length("b")
    same = (F.char_length("a") == F.char_length("b")) & (F.col("a") < F.col("b"))
    near = (shorter | same) & (F.levenshtein("a", "b", 1) == 1)
    met = chunks.alias("c").join(grams.alias("g"), (F.col("c.key") == F.col("g.key")) & near)
    return met.select("a", "n_a", "b", "n_b").distinct()


def forms(words: DataFrame, pairs: DataFrame, factor: int = FACTOR) -> DataFrame:
    """words(word, n), pairs(a, n_a, b, n_b) -> (word, n, n_near, form, form_n).

    The form is the near word of largest n, the smallest in code-point order among equals, if it is `factor` times as frequent.
    """
    side = lambda x, y: F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"n_{y}").alias("m"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("e")).select("e.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    taken = -F.col("best.m") >= factor * F.col("n")
    return joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(taken, F.col("best.near")).alias("form"),
        F.when(taken, -F.col("best.m")).alias("form_n"),
    )


def with_roots(formed: DataFrame) -> DataFrame:
    """Follow forms to the last one.  Counts grow along the way, so there is no circle; each round doubles the steps taken."""
    roots = saved(formed.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if roots.join(ahead, "root", "left_semi").isEmpty():
            break
        roots = saved(roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """docs(doc_id, text) -> (word, n, n_near, form, form_n, root), one row per word; an empty table has none.

    Other columns are ignored whatever their names.  Words, pairs and forms are written to the shared folder between steps.
    """
    words = saved(word_counts(docs.select("doc_id", "text"), min_length, min_count), "words")
    formed = saved(forms(words, near_pairs(words)), "forms")
    return with_roots(formed)
