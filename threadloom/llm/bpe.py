"""Byte-level BPE encoding and decoding with DuckDB inside Spark tasks.

Encoding: a recursive query holds one row per (word, position, token).  Each step joins neighbouring tokens with the merge
table, picks the leftmost pair of least rank of every word, contracts it, and stops for a word when nothing can be merged.
Decoding: token rows join the vocabulary and an ordered aggregation puts the pieces together.

A task reads its own partition only: nothing is shuffled, collected or broadcast.  Texts are cut at single spaces between
visible characters, where the pretokenizer always splits, so that equal chunks are encoded once per worker.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import lean, ragged, slices

#: Bytes of text per DuckDB call, tokens per decoding call, and entries in each generation of a worker's memory.
PIECE = 2 << 20
DECODE_TOKENS = 1 << 19
REMEMBERED = 100_000
#: A single pretoken beyond this many bytes needs as many recursion steps; it is merged with a heap instead, same rule.
LONG_WORD = 1024
#: White space as the rank files' pattern means it (Unicode White_Space, without the separators U+001C to U+001F).
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_CROWDED = re.compile(r"\s | \s")

#: Words in one recursive query, and the bits of a row key that hold the position inside a word (it holds LONG_WORD).
WORDS_PER_QUERY = 100_000
POSITION_BITS = 11

# A row's key k is (word << 11) + position.  merged << 28 + k orders pairs by rank, then from left to right.
MERGE = """
WITH RECURSIVE step(k, t, active) AS (
  SELECT k, t, true FROM start
  UNION ALL (
  WITH cur AS (
    SELECT k, t, lag(k) OVER () AS before, lead(k) OVER () AS after, t::BIGINT * 65536 + lead(t) OVER () AS pair
    FROM (SELECT k, t FROM step WHERE active ORDER BY k)),
  pairs AS (
    SELECT k, before, cur.t, k >> 11 AS w, m.t AS merged
    FROM cur LEFT JOIN merges m ON m.pair = cur.pair AND after >> 11 = k >> 11),
  best AS (SELECT w, min((merged::BIGINT << 28) + k) & 268435455 AS hit FROM pairs GROUP BY w)
  SELECT g.k, CASE WHEN g.k = hit THEN g.merged ELSE g.t END, hit IS NOT NULL
  FROM pairs g JOIN best USING (w) WHERE hit IS NULL OR before IS DISTINCT FROM hit))
SELECT k >> 11 AS w, t FROM step WHERE NOT active ORDER BY k
"""

DECODE = """
SELECT d, string_agg(piece, '') AS text
FROM (SELECT d, p, piece FROM tokens JOIN vocabulary USING (t) ORDER BY d, p) GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Memory(dict):
    """A bounded memory in two generations: what is used again survives, the rest is dropped a generation later."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def unknown(self, keys: set[str]) -> list[str]:
        """The keys that are in neither generation; those of the older one move to the younger."""
        out = []
        for key in keys:
            if key not in self:
                value = self.older.get(key)
                if value is None:
                    out.append(key)
                else:
                    self[key] = value
        return out

    def age(self, limit: int) -> None:
        if len(self) > limit:
            self.older = dict(self)
            self.clear()


class Codec:
    """A vocabulary in an in-memory DuckDB of this worker, and the chunks it has encoded so far."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.bytes_to_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.words, self.chunks = Memory(), Memory()
        merges = [
            (self.ranks[t[:k]], self.ranks[t[k:]], r)
            for t, r in self.ranks.items()
            for k in range(1, len(t))
            if t[:k] in self.ranks and t[k:] in self.ranks
        ]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        left, right, token = (np.array(c, np.int64) for c in zip(*merges, strict=True))
        self._fill("merges", pa.table({"pair": left * 65536 + right, "t": token.astype(np.int32)}))
        order = sorted(self.ranks.items(), key=lambda x: x[1])
        # One character per byte: DuckDB strings stay strings, and latin-1 turns them back into bytes.
        self._fill("vocabulary", pa.table({"t": pa.array([r for _, r in order], pa.int32()), "piece": [b.decode("latin-1") for b, _ in order]}))

    def _fill(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def _query(self, name: str, rows: pa.Table, sql: str) -> pa.Table:
        self.db.register(name, rows)
        try:
            return self.db.sql(sql).to_arrow_table()
        finally:
            self.db.unregister(name)

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known yet, all of them in one recursive query."""
        todo: list[bytes] = []
        names: list[str] = []
        for word in words:
            data = word.encode()
            rank = self.ranks.get(data)
            if rank is not None:
                self.words[word] = struct.pack("<I", rank)
            elif len(data) > LONG_WORD:
                self.words[word] = self._merge_long(data)
            else:
                todo.append(data)
                names.append(word)
        for i in range(0, len(todo), WORDS_PER_QUERY):
            self._merge(todo[i : i + WORDS_PER_QUERY], names[i : i + WORDS_PER_QUERY])

    def _merge(self, todo: list[bytes], names: list[str]) -> None:
        sizes = np.array([len(x) for x in todo])
        position = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        keys = (np.repeat(np.arange(len(todo)), sizes) << POSITION_BITS) + position
        start = pa.table({"k": keys, "t": self.bytes_to_id[np.frombuffer(b"".join(todo), np.uint8)]})
        out = self._query("start", start, MERGE)
        ids = out.column("t").to_numpy().astype("<u4").tobytes()
        counts = np.bincount(out.column("w").to_numpy(), minlength=len(todo))
        at = 0
        for name, n in zip(names, (4 * counts).tolist(), strict=True):
            self.words[name] = ids[at : at + n]
            at += n

    def _merge_long(self, data: bytes) -> bytes:
        """Leftmost pair of least rank first, with a heap over a linked list."""
        parts: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
        after, before = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)]
        heap = [(self.ranks[x], i, 2) for i in range(len(parts) - 1) if (x := data[i : i + 2]) in self.ranks]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left = parts[i]
            j = after[i] if left is not None else -1
            if j < 0 or len(left) + len(parts[j]) != size or data[i : i + size] not in self.ranks:
                continue
            parts[i], parts[j], after[i] = left + parts[j], None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (rank := self.ranks.get(parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (rank, k, len(parts[k]) + len(parts[after[k]])))
        return struct.pack(f"<{sum(p is not None for p in parts)}I", *[self.ranks[p] for p in parts if p is not None])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = []
        for text in texts:
            # Later chunks carry the space in front of them.
            parts = text.split(" ") if not _CROWDED.search(text) else _BREAK.split(text)
            cut.append([parts[0], *map(" ".__add__, parts[1:])])
        self.chunks.age(REMEMBERED)
        self.words.age(REMEMBERED)
        seen: set[str] = set()
        seen.update(*cut)
        pieces = {c: self.split(c) for c in self.chunks.unknown(seen)}
        names: set[str] = set()
        names.update(*pieces.values())
        self.learn(self.words.unknown(names))
        words = self.words
        for chunk, ws in pieces.items():
            self.chunks[chunk] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])
        return [b"".join(map(self.chunks.__getitem__, chunks)) for chunks in cut]

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes that sequences of ids stand for; an id outside the vocabulary stands for nothing."""
        out: list[bytes] = [b""] * len(encoded)
        start, held = 0, 0
        for i in range(len(encoded) + 1):
            size = len(encoded[i]) // 4 if i < len(encoded) else DECODE_TOKENS
            if held and held + size > DECODE_TOKENS:
                for d, text in self._decode(encoded[start:i]):
                    out[start + d] = text
                start, held = i, 0
            held += size
        return out

    def _decode(self, encoded: list[bytes]) -> Iterator[tuple[int, bytes]]:
        sizes = np.array([len(x) // 4 for x in encoded])
        ids = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
        rows = pa.table({"d": np.repeat(np.arange(len(encoded), dtype=np.int32), sizes), "p": np.arange(len(ids), dtype=np.int32), "t": ids})
        done = self._query("tokens", rows, DECODE)
        for d, text in zip(done.column("d").to_pylist(), done.column("text").to_pylist(), strict=True):
            yield d, text.encode("latin-1")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _apply(df: DataFrame, column: str, columns: list[str], types: list[str], make) -> DataFrame:
    """Add columns computed from one column, piece by piece; input columns of the same names are replaced."""
    df = df.drop(*columns)
    schema = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(columns, types, strict=True)]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, column, PIECE):
            yield pa.RecordBatch.from_arrays([*piece.columns, *make(piece.column(column))], names=[*piece.schema.names, *columns])

    return df.mapInArrow(lean(run), schema)


def _lists(encoded: list[bytes]) -> pa.Array:
    return ragged(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32), [len(x) // 4 for x in encoded], pa.int32())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add `ids` array<int>.  Null and empty texts give an empty array; no special tokens; every other column stays."""

    def make(column):
        return [_lists(codec(path, pattern).encode(column.fill_null("").to_pylist()))]

    return _apply(docs, text, [ids], ["array<int>"], make)


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add `decoded` binary.  Null and empty arrays give empty bytes; ids outside the vocabulary are left out."""
    packed = rows.withColumn("__ids", F.col(ids))
    schema = rows.drop(out).select("*", F.lit(None).cast("binary").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = [np.array([t for t in x or [] if t is not None], "<u4").tobytes() for x in batch.column("__ids").to_pylist()]
            keep = [n for n in batch.schema.names if n not in ("__ids", out)]
            decoded = codec(path, pattern).decode(sequences)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(decoded, pa.binary())], names=[*keep, out])

    return packed.mapInArrow(lean(run), schema)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Add n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 (the decoded bytes).

    Encodes and decodes within one pass over the partition; `with_ids` adds the ids themselves as array<int>.  Null texts
    count as empty; repeated rows give equal results; input columns of these names are replaced.
    """

    def make(column):
        c = codec(path, pattern)
        encoded = c.encode(column.fill_null("").to_pylist())
        decoded = c.decode(encoded)
        hexes = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        columns = [pa.array([len(x) // 4 for x in encoded], pa.int64()), hexes(encoded), hexes(decoded)]
        return columns + [_lists(encoded)] * with_ids

    names, types = ["n_tokens", "ids_sha256", "decoded_sha256"], ["bigint", "string", "string"]
    return _apply(docs, text, names + ["ids"] * with_ids, types + ["array<int>"] * with_ids, make)
