"""Quality rules: a threshold table compiled into one Spark projection of length, symbol, stop-word and line ratios.

Everything is a built-in function over the row's own arrays; there is no shuffle and no user function.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.barrier import once
from threadloom.llm.common import SPACE

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is it that was for on are with as by this be at from or an a "
    "le la les de des du un une et en que qui dans pour sur par au est avec "
    "der die das und den von zu mit sich ist nicht ein eine auf für im dem "
    "el los las una y es por con para del se su no lo"
).split()


class Rule(NamedTuple):
    """numerator * 1000 has to lie within [low, high] * denominator; None leaves that side open."""

    name: str
    numerator: str
    denominator: str
    low: int | None
    high: int | None


#: Limits are thousandths, so that every comparison is one of whole numbers.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "word_chars", "n_words", 2_000, 20_000),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 100),
    Rule("exclamations_per_word", "n_exclaims", "n_words", None, 200),
    Rule("stop_word_share", "n_stop_words", "n_words", 40, None),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 300),
    Rule("ellipsis_line_share", "n_ellipsis_lines", "n_lines", None, 300),
)
MIN_WORDS = 50
#: Percent of a text's words that may lie in repeated three-word windows.
MAX_REPEATED = 50

_TEXT, _WORDS, _LINES, _SORTED = "__q_text", "__q_words", "__q_lines", "__q_sorted"


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_exclaims, n_stop_words, n_lines, n_dup_lines, n_ellipsis_lines and n_repeat_words.

    A null text counts as empty: every measure is 0.  Columns of these names in the input are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    staged = once(docs.drop(*MEASURES), **{_TEXT: body})
    staged = once(
        staged,
        **{
            _WORDS: F.filter(F.split(_TEXT, SPACE), lambda w: w != ""),
            _LINES: F.filter(F.split(_TEXT, "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]")),
        },
    )
    # The three-word windows, sorted by their hash with their position: equal windows become neighbours.
    last = F.size(_WORDS) - 2
    windows = F.transform(
        F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.xxhash64(*[F.get(F.col(_WORDS), i + k) for k in range(3)]).alias("h"), i.alias("i")),
    )
    staged = once(staged, **{_SORTED: F.array_sort(windows)})
    n = F.size(_SORTED)
    rest = F.greatest(n - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(_SORTED, F.lit(1), rest),
        F.slice(_SORTED, F.lit(2), rest),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    starts = F.array_distinct(F.flatten(pairs))
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    chars = lambda drop: F.length(F.regexp_replace(_TEXT, drop, ""))
    return once(
        staged,
        **{
            "n_words": F.size(_WORDS).cast("bigint"),
            "word_chars": chars(SPACE).cast("bigint"),
            "n_symbols": chars("[^#*$%&|<>]+").cast("bigint"),
            "n_exclaims": chars("[^!]+").cast("bigint"),
            "n_stop_words": F.size(F.filter(_WORDS, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("bigint"),
            "n_lines": F.size(_LINES).cast("bigint"),
            "n_dup_lines": (F.size(_LINES) - F.size(F.array_distinct(_LINES))).cast("bigint"),
            "n_ellipsis_lines": F.size(F.filter(_LINES, lambda s: s.rlike("(\\.\\.\\.|…)\\s*$"))).cast("bigint"),
            "n_repeat_words": F.size(covered).cast("bigint"),
        },
    ).drop(_TEXT, _WORDS, _LINES, _SORTED)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_exclaims", "n_stop_words", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_repeat_words")


def passes(rule: Rule) -> Column:
    value, unit = F.col(rule.numerator) * 1000, F.col(rule.denominator)
    checks = [value >= rule.low * unit] * (rule.low is not None) + [value <= rule.high * unit] * (rule.high is not None)
    out = checks[0]
    for c in checks[1:]:
        out = out & c
    return out


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add the measures, base_failed, failed_rules (names, in the order of the table) and kept.

    base_failed: under 50 words, or more than half of the words in repeated three-word windows.  kept: not base_failed and
    no rule failed.  Empty and null texts fail the base; repeated rows are judged alike; other columns stay as they are.
    """
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    failed = F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    measured = measures(docs.drop("base_failed", "failed_rules", "kept"), text)
    return measured.withColumns({"base_failed": base, "failed_rules": failed}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)
    )
