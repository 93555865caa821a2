"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a run of 13 consecutive words of a benchmark item (an item of fewer words is one pattern).  Per pattern
length m the search looks at blocks of two words: the shift table tells how far the window may move when its last block
ends no pattern, the suffix bucket of a block lists the patterns that end with it, and those are compared word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import lean, raw

WINDOW = 13
#: Bytes of benchmark text in one block of patterns; a larger benchmark is searched in several blocks, one after another.
BLOCK_BYTES = 4 << 20
#: ASCII letters and digits and every byte of a multi-byte character belong to words; A-Z are lowered, the rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

State = list[tuple[int, int]]


def bench_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Patterns(NamedTuple):
    """The search tables of the patterns of one length."""

    length: int
    shift: dict[tuple[bytes, ...], int]
    suffix: dict[tuple[bytes, ...], list[tuple[list[bytes], frozenset[str]]]]


def compile_patterns(items: list[tuple[str, bytes]], window: int = WINDOW) -> list[Patterns]:
    """Shift tables and suffix buckets by pattern length."""
    owners: dict[int, dict[tuple[bytes, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = bench_words(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            owners[m][tuple(words[i : i + m])].add(item)
    out = []
    for m, patterns in owners.items():
        size = min(2, m)
        shift: dict[tuple[bytes, ...], int] = {}
        suffix = defaultdict(list)
        for words, names in patterns.items():
            for end in range(size, m + 1):
                block = words[end - size : end]
                shift[block] = min(shift.get(block, m), m - end)
            suffix[words[m - size :]].append((list(words), frozenset(names)))
        out.append(Patterns(m, shift, dict(suffix)))
    return out


def search(words: list[bytes], tables: list[Patterns]) -> tuple[State, set[str]]:
    """Word intervals covered by patterns, and the items whose patterns occur."""
    spans, names = [], set()
    n = len(words)
    for m, shift, suffix in tables:
        size = min(2, m)
        far = m - size + 1
        end = m
        while end <= n:
            block = tuple(words[end - size : end])
            step = shift.get(block, far)
            if step:
                end += step
                continue
            for pattern, owners in suffix[block]:
                if words[end - m : end] == pattern:
                    spans.append((end - m, end))
                    names |= owners
            end += 1
    return spans, names


def covered(spans: State) -> int:
    total, reach = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return total


def _blocks(bench: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of bounded size, streamed partition by partition."""
    held, size = [], 0
    for row in bench.where(F.col(text).isNotNull()).select(F.col(item).cast("string"), F.col(text).cast("binary")).toLocalIterator():
        value = bytes(row[1])
        if held and size + len(value) > limit:
            yield held
            held, size = [], 0
        held.append(("" if row[0] is None else row[0], value))
        size += len(value)
    if held:
        yield held


def contamination(
    docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """All columns of `docs`, then n_words, n_hit, hit_items (sorted strings) and contaminated.

    A word is hit when it lies in an occurrence of any pattern; contaminated: n_hit > 0 and 20 * n_hit >= n_words.  Null
    texts have no words, null benchmark texts no patterns, a null item id counts as the empty string.  Repeated rows are
    searched alike; result columns replace input columns of the same name.  Documents are read once per benchmark block
    in a chain of narrow steps: nothing is shuffled, and a task holds one block of tables and one Arrow batch.  The last
    block is searched by the worker that counts, so a benchmark of one block needs one Python worker per task.
    """
    results = ["n_words", "n_hit", "hit_items", "contaminated"]
    docs = docs.drop(*results)
    state = docs.select("*", F.lit(None).cast("array<struct<a:int,b:int>>").alias("__spans"), F.lit(None).cast("array<string>").alias("__items"))
    *earlier, last = list(map(compile_patterns, _blocks(bench, item, item_text, block_bytes))) or [[]]
    for tables in earlier:
        state = state.mapInArrow(lean(_pass(tables, text)), state.schema)
    search_last, count = _pass(last, text), _count(text)
    schema = docs.select("*", F.lit(0).cast("bigint").alias("n_words"), F.lit(0).cast("bigint").alias("n_hit"), F.lit(None).cast("array<string>").alias("hit_items")).schema
    counted = state.mapInArrow(lean(lambda batches: count(search_last(batches))), schema)
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _pass(tables: list[Patterns], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("__spans")
            spans, items = [], []
            for body, old, had in zip(raw(batch.column(text)), batch.column(at), batch.column(at + 1), strict=True):
                found, owners = search(bench_words(body.as_py()), tables)
                spans.append((old.as_py() or []) + [{"a": a, "b": b} for a, b in found])
                items.append(sorted({*(had.as_py() or []), *owners}))
            kinds = [batch.schema.field(i).type for i in (at, at + 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(spans, kinds[0]), pa.array(items, kinds[1])], schema=batch.schema
            )

    return run


def _count(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("__spans")
            words = [len(bench_words(x.as_py())) for x in raw(batch.column(text))]
            hit = [covered([(s["a"], s["b"]) for s in x.as_py() or []]) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(words, pa.int64()), pa.array(hit, pa.int64()), batch.column(at + 1)],
                names=[*batch.schema.names[:at], "n_words", "n_hit", "hit_items"],
            )

    return run


def cleaned(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """`docs` without the contaminated ones, columns unchanged."""
    return contamination(docs, bench, **options).where(~F.col("contaminated")).select(*docs.columns)
