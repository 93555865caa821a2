"""Removal of every byte covered by a LENGTH-byte string that starts more than once, over a sampled suffix order.

A difference cover samples suffixes so that any two equal strings meet at sampled suffixes at the same distance from
their starts.  Here the sample is chosen by content: of the GRAM-byte strings that start in a window, the one with the least
hash.  Every LENGTH-byte string contains such an anchor, equal strings have it at the same place, and the starts that have
the same anchor form a short range.  One position in about fifty is sampled, whole documents agree on the sample without
aligning their offsets, and nothing is ranked over the whole corpus:

1. names: sampled anchors get the hash of their gram as a name; only names that occur twice can belong to repeats.
2. recursion on longer strings: ranges of starts with such a name are named by all bytes they see.  Equal names again: every
   start in the range is a repeat.
3. merge of the rest: the remaining ranges of a name are brought together with their bytes, with one range per name of step
   2; their LENGTH-byte prefixes are named and sorted, and neighbours compared.  Where a name has more than MANY such ranges, the
   hashes of the prefixes are counted and joined instead, so that no task holds a whole name.

Names are 64-bit hashes.  Copies of whole texts are counted by digest and take part once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import mixed, ragged, raw
from threadloom.session import saved

LENGTH = 200
GRAM = 100
#: Positions are handled in segments, so that hash and position of a gram fit into 64 bits.
_SEGMENT, _BITS = 1 << 19, 20
#: Bytes of ranges whose prefixes are sorted together.
_TOGETHER = 4 << 20
#: Most ranges of a name that one task compares.
MANY = 1_000

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        make = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
        _POWERS.clear()
        _POWERS[size] = make(_BASE), make(_BACK)
    return _POWERS[size]


class Rolling:
    """Hashes of any substring of `data` in constant time."""

    def __init__(self, data: np.ndarray):
        power, self.back = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


class Ranges(NamedTuple):
    """Per sampled anchor: its name, the first and last string start that belong to it, and the name of all they see."""

    name: np.ndarray
    low: np.ndarray
    high: np.ndarray
    outer: np.ndarray


def ranges_of(text: bytes, length: int = LENGTH, gram: int = GRAM) -> Ranges:
    data = np.frombuffer(text, np.uint8)
    starts = len(data) - length + 1
    parts = []
    with np.errstate(over="ignore"):
        for at in range(0, max(starts, 0), _SEGMENT):
            roll = Rolling(data[at : min(at + _SEGMENT, starts) + length - 1])
            grams = roll.all(gram)
            best = (grams >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(len(grams), dtype=np.uint64)
            width = length - gram + 1
            reach = 1
            while 2 * reach <= width:
                best = np.minimum(best[:-reach], best[reach:])
                reach *= 2
            if reach < width:
                best = np.minimum(best[: len(best) - (width - reach)], best[width - reach :])
            anchor = (best & np.uint64((1 << _BITS) - 1)).astype(np.int64)
            low = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
            high = np.concatenate([low[1:] - 1, [len(anchor) - 1]])
            outer = mixed(roll.of(low, high + length) + (high - low).astype(np.uint64))
            parts.append((grams[anchor[low]], low + at, high + at, outer))
    if not parts:
        none = np.zeros(0, np.int64)
        return Ranges(none.astype(np.uint64), none, none, none.astype(np.uint64))
    return Ranges(*[np.concatenate(x) for x in zip(*parts, strict=True)])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, key, n_bytes, digest, sha256, names) per document; of copies in a task only the first brings names."""
    mark = TaskContext.get().partitionId() << 33
    seen: set[bytes] = set()
    for batch in batches:
        rows, names = [], []
        for body in raw(batch.column("text")):
            text = body.as_py()
            d = hashlib.sha256(text).digest()
            rows.append((len(text), d[:16], d.hex()))
            names.append(ranges_of(text).name if d not in seen else np.zeros(0, np.uint64))
            seen.add(d)
        if len(seen) > 200_000:
            seen.clear()
        size, digest, sha = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(mark, mark + len(rows))),
                batch.column("key"),
                pa.array(size, pa.int64()),
                pa.array(digest, pa.binary()),
                pa.array(sha, pa.string()),
                ragged(np.concatenate([np.zeros(0, np.uint64), *names]).view(np.int64), [len(x) for x in names], pa.int64()),
            ],
            ["mark", "key", "n_bytes", "digest", "sha256", "names"],
        )
        mark += len(rows)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, name, outer, low, high) of the ranges whose name is among those of the row."""
    for batch in batches:
        for mark, body, names in zip(batch.column("mark").to_pylist(), raw(batch.column("text")), batch.column("names"), strict=True):
            r = ranges_of(body.as_py())
            keep = np.isin(r.name, np.array(names.as_py(), np.int64).view(np.uint64))
            columns = [r.name[keep], r.outer[keep], r.low[keep], r.high[keep]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(keep.sum(), mark, np.int64)), *map(_signed, columns)], ["mark", "name", "outer", "low", "high"]
            )


def _seen_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, mark, low, open, bytes): what the strings of each wanted range see."""
    for batch in batches:
        for mark, body, wanted in zip(batch.column("mark").to_pylist(), raw(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
            text = body.as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([w["name"] for w in wanted], pa.int64()),
                    pa.array([mark] * len(wanted), pa.int64()),
                    pa.array([w["low"] for w in wanted], pa.int64()),
                    pa.array([w["open"] for w in wanted], pa.bool_()),
                    pa.array([text[w["low"] : w["high"] + LENGTH] for w in wanted], pa.binary()),
                ],
                ["name", "mark", "low", "open", "bytes"],
            )


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(mark, start, open, prefix): the name of each string that starts in a wanted range."""
    for batch in batches:
        for mark, body, wanted in zip(batch.column("mark").to_pylist(), raw(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
            data = np.frombuffer(body.as_py(), np.uint8)
            parts = []
            for w in wanted:
                with np.errstate(over="ignore"):
                    name = mixed(np.array([w["name"]], np.int64).view(np.uint64))
                    prefix = mixed(Rolling(data[w["low"] : w["high"] + LENGTH]).all(LENGTH) ^ name)
                n = len(prefix)
                parts.append((np.full(n, mark, np.int64), np.arange(n) + w["low"], np.full(n, w["open"]), prefix.view(np.int64)))
            columns = [pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["mark", "start", "open", "prefix"])


def _compare(rows: list[tuple[int, int, int, bool, bytes]]) -> pa.RecordBatch:
    """Covered stretches (mark, low, high) of the open ranges: starts whose string occurs in another range of the name."""
    sizes = np.array([len(r[4]) for r in rows])
    with np.errstate(over="ignore"):
        roll = Rolling(np.frombuffer(b"".join(r[4] for r in rows), np.uint8))
        counts = sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(rows)), counts)
        inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = (np.cumsum(sizes) - sizes)[owner] + inner
        names = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        prefix = mixed(roll.of(at, at + LENGTH) ^ mixed(names)[owner])
    order = np.argsort(prefix, kind="stable")
    same = prefix[order][1:] == prefix[order][:-1]
    again = np.zeros(len(prefix), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    again &= np.array([r[3] for r in rows])[owner]
    hit = np.flatnonzero(again)
    fresh = np.ones(len(hit), bool)
    fresh[1:] = (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)
    first = hit[fresh]
    last = hit[np.append(np.flatnonzero(fresh)[1:] - 1, len(hit) - 1)] if len(hit) else hit
    marks, lows = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(marks[owner[first]]), pa.array(lows[owner[first]] + inner[first]), pa.array(lows[owner[last]] + inner[last])], ["mark", "low", "high"]
    )


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by name; whole names are compared together."""
    held, size, name = [], 0, None
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("name", "mark", "low", "open", "bytes")], strict=True):
            if row[0] != name and size > _TOGETHER:
                yield _compare(held)
                held, size = [], 0
            name = row[0]
            held.append(row)
            size += len(row[4])
    if held:
        yield _compare(held)


def remove(text: bytes, stretches: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The text without the strings that start in the stretches; bytes removed, and maximal runs of them."""
    out, kept_from, gone, runs = [], 0, 0, 0
    for low, high in sorted(stretches):
        end = high + LENGTH
        if low > kept_from or not runs:
            out.append(text[kept_from:low])
            gone += end - low
            runs += 1
            kept_from = end
        elif end > kept_from:
            gone += end - kept_from
            kept_from = end
    out.append(text[kept_from:])
    return b"".join(out), gone, runs


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for mark, body, stretches in zip(batch.column("mark").to_pylist(), raw(batch.column("text")), batch.column("stretches").to_pylist(), strict=True):
            kept, gone, runs = remove(body.as_py(), [(s["low"], s["high"]) for s in stretches])
            out.append((mark, gone, runs, kept))
        columns = list(zip(*out, strict=True)) if out else [(), (), (), ()]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["mark", "n_removed", "n_spans", "kept"])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: (mark, key, n_bytes, sha256, copied) per row of `docs`, and (mark, n_removed, n_spans, kept bytes).

    The second has the rows that lose some of their bytes (the same row again for each repetition of key and text); rows that are `copied` (their text, of LENGTH bytes or more, occurs
    in another row) lose all.  Null texts count as empty; repeated rows are copies of each other; keys are only handed on, so
    they may be null or repeated; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    texts = saved(rows.mapInArrow(_texts, f"mark bigint, key {kind}, n_bytes bigint, digest binary, sha256 string, names array<bigint>"), "texts")
    copies = texts.where(F.col("n_bytes") >= LENGTH).groupBy("digest").count().where("count > 1").select("digest", F.lit(True).alias("copied"))

    occurrences = texts.select("mark", F.explode("names").alias("name"))
    twice = occurrences.groupBy("name").count().where("count > 1").select("name")
    found = occurrences.join(twice, "name").groupBy("mark").agg(F.collect_set("name").alias("names"))
    owners = found.join(texts.select("mark", F.col("key").alias("__key"), "sha256"), "mark")
    involved = rows.withColumn("__sha", F.sha2(F.coalesce("text", F.lit("")), 256)).join(
        owners, F.col("key").eqNullSafe(F.col("__key")) & (F.col("__sha") == F.col("sha256"))
    )
    involved = saved(involved.select("mark", "text", "names"), "involved")

    ranges = saved(involved.mapInArrow(_named, "mark bigint, name bigint, outer bigint, low bigint, high bigint"), "ranges")
    classes = ranges.groupBy("name", "outer").agg(F.count("*").alias("c"), F.min("mark").alias("first"))
    crowd = classes.groupBy("name").agg(F.count("*").alias("classes"))
    judged = ranges.join(classes.join(crowd, "name"), ["name", "outer"]).where("c > 1 OR classes > 1")
    judged = saved(judged, "judged")
    compared = judged.where("classes > 1 AND (c = 1 OR mark = first)")

    def wanted(some: str) -> DataFrame:
        listed = F.collect_list(F.struct("name", "low", "high", (F.col("c") == 1).alias("open"))).alias("wanted")
        return involved.select("mark", "text").join(compared.where(some).groupBy("mark").agg(listed), "mark")

    seen = wanted(f"classes <= {MANY}").mapInArrow(_seen_bytes, "name bigint, mark bigint, low bigint, open boolean, bytes binary")
    starts = saved(wanted(f"classes > {MANY}").mapInArrow(_prefixes, "mark bigint, start bigint, open boolean, prefix bigint"), "starts")
    again = starts.groupBy("prefix").count().where("count > 1").select("prefix")
    met = starts.where("open").join(again, "prefix", "left_semi").select("mark", F.col("start").alias("low"), F.col("start").alias("high"))
    stretches = seen.repartition("name").sortWithinPartitions("name").mapInArrow(_merge, "mark bigint, low bigint, high bigint")
    stretches = stretches.unionByName(met).unionByName(judged.where("c > 1").select("mark", "low", "high"))
    lists = stretches.groupBy("mark").agg(F.collect_list(F.struct("low", "high")).alias("stretches"))
    partly = involved.select("mark", "text").join(lists, "mark").mapInArrow(_removed, "mark bigint, n_removed bigint, n_spans bigint, kept binary")
    base = texts.select("mark", "key", "n_bytes", "digest", "sha256").join(copies, "digest", "left").drop("digest")
    return base.withColumn("copied", F.coalesce("copied", F.lit(False))), partly


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) per row of `docs`; see `repeats` for unusual rows."""
    base, partly = repeats(docs, key, text)
    digests = partly.select("mark", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept")).dropDuplicates(["mark"])
    pick = lambda full, part, none: F.when(F.col("copied"), full).otherwise(F.coalesce(part, none))
    zero = F.lit(0).cast("bigint")
    return base.join(digests, "mark", "left").select(
        F.col("key").alias(key),
        "n_bytes",
        pick(F.col("n_bytes"), "n_removed", zero).alias("n_removed"),
        pick(F.lit(1).cast("bigint"), "n_spans", zero).alias("n_spans"),
        pick(F.sha2(F.lit(""), 256), "kept", F.col("sha256")).alias("kept_sha256"),
    )
