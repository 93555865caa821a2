"""Substring deduplication over sliding sentence spans.

A text is cut into units: at the ends of sentences, and behind the word of least hash in every window of PIECE_WORDS words.  Both
depend only on the words around, so a passage gets the same units at any offset, except within PIECE_WORDS words of its ends; one
of 3 * PIECE_WORDS + MIN_WORDS - 2 words or more always has a run of whole units.  Every run of consecutive units
that just reaches MIN_WORDS words is hashed, forwards from each unit and backwards from each unit; runs meet in one global
aggregation, and every unit covered by a repeated run is removed unless it lies in the run's first occurrence.

Texts are cut and hashed once, into a written table.  Repeated runs are marked in a bitmap of fixed size, and only runs whose
bit is set are shuffled a second time, to find their documents; a bit set by chance costs a row and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import hashes as word_hashes
from threadloom.llm.common import lean, mixed, ragged, raw
from threadloom.session import saved

#: The most words of a unit that is no first or last one of a text.
PIECE_WORDS = 9
#: A run has at least two units and at least this many words.
MIN_WORDS = 24
#: The bitmap of repeated runs has 2 ** BITMAP_BITS bits (16 MB), whatever the input.
BITMAP_BITS = 27
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_IS_END = np.isin(np.arange(256), list(b".!?"))
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


class Units(NamedTuple):
    starts: list[int]  # byte offsets; a unit reaches to the start of the next one
    words: np.ndarray
    hashes: np.ndarray


def _powers(n: int, held: dict[int, np.ndarray] = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The first n powers of the base and of its inverse; a worker keeps those it has made for texts of usual length."""
    if n > 1 << 16:
        return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_BASE, _BACK))
    if not held:
        held.update((x, np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full((1 << 16) - 1, x, np.uint64)]))) for x in (_BASE, _BACK))
    return held[_BASE][:n], held[_BACK][:n]


def _spanned(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each values[a:b], equal for equal sequences wherever they lie."""
    with np.errstate(over="ignore"):
        power, back = _powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mixed(values) * power[:-1], out=sums[1:])
        return mixed((sums[b] - sums[a]) * back[a] + (b - a).astype(np.uint64))


def units_of(text: bytes) -> Units:
    """Units with their white space behind them; leading white space belongs to the first unit."""
    low = text.lower()
    ws = low.split()
    n = len(ws)
    if not n:
        return Units([], np.zeros(0, np.int64), np.zeros(0, np.uint64))
    chars = np.frombuffer(low, np.uint8)
    edges = np.flatnonzero(np.diff(_IS_SPACE[chars], prepend=True, append=True))
    at, behind = edges[::2], edges[1::2]
    # A sentence ends with a word that ends in . ! or ?, and before a line break.
    opens = np.zeros(n + 1, bool)
    opens[0] = True
    opens[1:] = _IS_END[chars[behind - 1]]
    opens[np.searchsorted(at, np.flatnonzero(chars == 10))] = True
    hs = word_hashes(ws)
    if n >= PIECE_WORDS:
        # The last of the least hashes of a window; `least` and `where` hold the best of the words seen so far.
        m = n - PIECE_WORDS + 1
        least, where = hs[:m].copy(), np.arange(m)
        for k in range(1, PIECE_WORDS):
            better = hs[k : k + m] <= least
            np.copyto(least, hs[k : k + m], where=better)
            where[better] = np.flatnonzero(better) + k
        opens[where + 1] = True
    first = np.flatnonzero(opens[:n])
    last = np.append(first[1:], n)
    return Units([0, *at[first[1:]].tolist()], last - first, _spanned(hs, first, last))


def runs(units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first unit, unit behind the last) of the shortest sufficient runs from each unit onwards and backwards."""
    n = len(units.words)
    total = np.concatenate([[0], np.cumsum(units.words)])
    first = np.arange(n)
    last = np.maximum(first + 2, np.searchsorted(total, total[:-1] + MIN_WORDS, "left"))
    until = np.arange(1, n + 1)
    since = np.minimum(until - 2, np.searchsorted(total, total[1:] - MIN_WORDS, "right") - 1)
    # A run that is shortest both ways is listed once.
    back = np.flatnonzero(since >= 0)
    back = back[last[since[back]] != until[back]]
    a = np.concatenate([first[last <= n], since[back]])
    b = np.concatenate([last[last <= n], until[back]])
    return _spanned(units.hashes, a, b), a, b


@lean
def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, body, n_units, inside, spans) per text: its distinct runs, and whether one of them occurs in it twice."""
    for batch in batches:
        values, counts, n_units, inside = [np.zeros(0, np.uint64)], [], [], []
        for text in raw(batch.column("text")):
            units = units_of(text.as_py())
            h = runs(units)[0]
            distinct = np.unique(h)
            values.append(distinct)
            counts.append(len(distinct))
            n_units.append(len(units.starts))
            inside.append(len(distinct) < len(h))
        spans = ragged(np.concatenate(values).view(np.int64), counts, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("body"), pa.array(n_units, pa.int64()), pa.array(inside, pa.bool_()), spans],
            ["key", "body", "n_units", "inside", "spans"],
        )


def _bitmap(repeated: DataFrame) -> np.ndarray:
    """One bit for each value of the upper BITMAP_BITS bits of a run: whether some repeated run has it."""
    bit = F.shiftrightunsigned("run", 64 - BITMAP_BITS) + 1  # Spark's bitmaps count from one
    parts = repeated.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros(1 << BITMAP_BITS >> 3, np.uint8)
    for row in parts.toLocalIterator():
        out[(row.part - 1) * len(row.bits) : row.part * len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return out


def _marked(bitmap: np.ndarray):
    """(key, run) of the runs whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            values = spans.flatten().to_numpy(zero_copy_only=False)
            bit = values.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
            hit = (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
            owner = np.repeat(np.arange(batch.num_rows), spans.value_lengths().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owner[hit])), pa.array(values[hit])], ["key", "run"])

    return lean(run)


def keep_first(text: bytes, later: np.ndarray) -> tuple[bytes, int, int]:
    """The text without the units of runs that are `later` or that occurred before in it; its units, and how many went."""
    units = units_of(text)
    n = len(units.starts)
    h, a, b = runs(units)
    gone = np.zeros(n + 1, np.int64)
    order = np.argsort(a, kind="stable")
    again = np.ones(len(h), bool)
    again[order[np.unique(h[order], return_index=True)[1]]] = False
    hit = again | np.isin(h, later)
    np.add.at(gone, a[hit], 1)
    np.add.at(gone, b[hit], -1)
    out = np.cumsum(gone[:-1]) > 0
    if not out.any():
        return text, n, 0
    ends = [*units.starts[1:], len(text)]
    kept = b"".join(text[s:e] for s, e, o in zip(units.starts, ends, out.tolist(), strict=True) if not o)
    return kept, n, int(out.sum())


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with `text` shortened, plus n_units and n_removed.

    The first occurrence of a run is the one in the document of the smallest key, and there the earliest; everything that
    any later occurrence covers goes.  Null texts stay null (no units); texts without words stay as they are; rows that share
    a key are one document, so repeated rows keep the same text; null keys come last and count as one document.  Columns
    n_units and n_removed of the input are replaced, all others stay.

    Shuffles: (run, key) pairs, 16 bytes each, pre-aggregated by run; those whose run has its bit set, joined with the
    repeated runs; and the texts once.  A run in very many documents is only ever counted, or split by the skew join; nothing
    gathers its documents.  Intermediates are written when the function is called.
    """
    docs = docs.drop("n_units", "n_removed")
    body = F.xxhash64(F.col(text))
    keyed = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), body.alias("body"))
    kind = keyed.schema["key"].dataType.simpleString()
    spans = saved(keyed.mapInArrow(_spans, f"key {kind}, body bigint, n_units bigint, inside boolean, spans array<bigint>"), "spans")
    counted = spans.select("key", F.explode("spans").alias("run")).groupBy("run").agg(F.count("*").alias("n"), F.min("key").alias("owner"))
    repeated = saved(counted.where("n > 1").select("run", "owner"), "repeated")
    marked = spans.select("key", "spans").mapInArrow(_marked(_bitmap(repeated)), f"key {kind}, run bigint")
    later = marked.join(repeated, "run").where(~F.col("key").eqNullSafe(F.col("owner")))
    lists = later.groupBy("key").agg(F.collect_set("run").alias("__later")).withColumnRenamed("key", "__key")
    # Rows of one key and one text have the same units.
    found = spans.groupBy("key", "body").agg(F.max("n_units").alias("__n_units"), F.max("inside").alias("__inside"))
    found = found.join(lists, F.col("key").eqNullSafe(F.col("__key")), "left").drop("__key")
    found = found.withColumnsRenamed({"key": "__key", "body": "__body"})
    joined = docs.join(found, F.col(key).eqNullSafe(F.col("__key")) & (body == F.col("__body")), "left").drop("__key", "__body")
    return joined.mapInArrow(
        _shorten(text), docs.select("*", F.lit(0).cast("bigint").alias("n_units"), F.lit(0).cast("bigint").alias("n_removed")).schema
    )


def _shorten(text: str):
    """Cut the texts that hold a repeated run; all others pass as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            column = raw(batch.column(at))
            new, gone = {}, np.zeros(batch.num_rows, np.int64)
            for i, (inside, later) in enumerate(zip(batch.column("__inside").to_pylist(), batch.column("__later"), strict=True)):
                if inside or later.is_valid:
                    runs_of_others = np.zeros(0, np.int64) if not later.is_valid else later.values.to_numpy(zero_copy_only=False)
                    new[i], _, gone[i] = keep_first(column[i].as_py(), runs_of_others.view(np.uint64))
            names = [n for n in batch.schema.names if not n.startswith("__")]
            columns = {n: batch.column(n) for n in names}
            changed = np.flatnonzero(gone)
            if len(changed):
                mask = np.zeros(batch.num_rows, bool)
                mask[changed] = True
                texts = pa.array([new[i] for i in changed.tolist()], pa.binary()).cast(pa.string())
                columns[text] = pc.replace_with_mask(columns[text], pa.array(mask), texts)
            yield pa.RecordBatch.from_arrays([*columns.values(), batch.column("__n_units"), pa.array(gone)], [*names, "n_units", "n_removed"])

    return lean(run)
