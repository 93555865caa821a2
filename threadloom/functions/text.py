"""Column expressions over text: tokens, sentences, similarity, costs, snippets.

Every function takes and returns a Column, so the work stays in the JVM and can be fused with the scan that feeds it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import fixed

BLANKS = " \t\n\r\x0b\x0c"


def strip(text) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.btrim(text, F.lit(BLANKS))


def words(text) -> Column:
    """Lower-case word tokens, underscores included (summaries, topics)."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zA-Z0-9_]+"), F.lit(0))


def terms(text) -> Column:
    """Lower-case search tokens, letters and digits only (search, recall, conflicts)."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def string_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def phrases(text) -> Column:
    """Distinct words of three letters or more without the agreement stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_except(found, string_array(fixed.AGREEMENT_STOP_WORDS))


def content_words(tokens) -> Column:
    """Drop summary stop words, keeping repeats."""
    return F.filter(tokens, lambda t: ~t.isin(list(fixed.SUMMARY_STOP_WORDS)))


def keywords(text) -> Column:
    """Distinct non-stop words longer than two characters (topic detection)."""
    distinct = F.array_except(words(text), string_array(fixed.SUMMARY_STOP_WORDS))
    return F.filter(distinct, lambda t: F.length(t) > 2)


def sentences(text) -> Column:
    """Split after . ! ? followed by white space; trimmed, empty pieces dropped."""
    parts = F.split(strip(text), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def jaccard(left, right, both_empty: float = 0.0) -> Column:
    """Jaccard similarity of two arrays of distinct values."""
    shared = F.size(F.array_intersect(left, right))
    union = F.size(left) + F.size(right) - shared
    return F.when((F.size(left) == 0) & (F.size(right) == 0), F.lit(both_empty)).otherwise(
        F.coalesce(F.try_divide(shared.cast("double"), union.cast("double")), F.lit(0.0))
    )


def token_estimate(text) -> Column:
    """Four characters per token, at least one for any text."""
    size = F.length(F.coalesce(text, F.lit("")))
    return F.when(size == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(size / 4).cast("int")))


def dot(left, right) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )


def cosine(left, right) -> Column:
    """Cosine similarity; 0 for vectors of different length or without norm."""
    norm = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    usable = (F.size(left) == F.size(right)) & (F.size(left) > 0)
    return F.when(usable, F.coalesce(F.try_divide(dot(left, right), norm), F.lit(0.0))).otherwise(F.lit(0.0))


def age_days(now, moment) -> Column:
    """Days between two timestamps, with fractions, never negative."""
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(moment)) / F.lit(86_400_000_000.0))


def recency(age, half_life: float) -> Column:
    """Exponential decay by half-life; no decay for ages or half-lives of zero or less."""
    if half_life <= 0:
        return F.lit(1.0)
    return F.when(age <= 0, F.lit(1.0)).otherwise(F.exp(-F.log(F.lit(2.0)) / half_life * age))


def name_key(name) -> Column:
    return strip(F.lower(name))


def snippet(text, tokens, before: int = 50, after: int = 150) -> Column:
    """Text around the earliest hit of any token, with dots where it was cut."""
    size = F.length(text)
    hits = F.filter(F.transform(tokens, lambda t: F.instr(F.lower(text), t)), lambda p: p > 0)
    first = F.coalesce(F.array_min(hits) - 1, size)
    start = F.greatest(F.lit(0), first - before)
    end = F.least(size, first + after)
    body = strip(F.substring(text, start + 1, end - start))
    return F.concat(
        F.when(start > 0, F.lit("...")).otherwise(F.lit("")),
        body,
        F.when(end < size, F.lit("...")).otherwise(F.lit("")),
    )


def truncate_artifact(content, max_tokens: int) -> Column:
    """Cut to max_tokens * 4 characters, back to the last newline when that lies past half, and mark the cut."""
    limit = max_tokens * 4
    head = F.substring(content, 1, limit)
    back = F.instr(F.reverse(head), "\n")
    last_newline = F.when(back > 0, F.length(head) - back).otherwise(F.lit(-1))
    cut = F.when(last_newline > limit // 2, F.substring(head, F.lit(1), last_newline)).otherwise(head)
    return F.concat(cut, F.lit("\n... [truncated]"))


def message_identity(role, index, text) -> Column:
    """Stable identity of a message within a conversation."""
    return F.sha2(F.concat_ws(":", role, index.cast("string"), F.substring(text, 1, 200)), 256)


def conversation_url(url) -> Column:
    """The URL without query string and fragment."""
    return F.regexp_replace(url, r"[?#].*$", "")


def conversation_identity(platform, url) -> Column:
    return F.concat(platform, F.lit(":"), F.substring(F.sha2(conversation_url(url), 256), 1, 16))


def squeeze_blanks(text) -> Column:
    """At most one empty line in a row, at most one blank in a row, trimmed."""
    lines = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(lines, r"[ \t]+", " "))
