"""What several operators share: reading tables, words as bytes and as 64-bit hashes, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and RE2 form of the white space that separates words.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column as bytes, null as empty, without decoding it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of a piece stays near `limit` bytes; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(np.frombuffer(raw(batch.column(column)).buffers()[1], np.int64, batch.num_rows + 1))
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        yield batch.slice(start)


def lean(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """Let a worker return freed memory to the system at the end of a partition; it lives on, idle, beside later stages."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch], *args, **kwargs) -> Iterator[pa.RecordBatch]:
        yield from run(batches, *args, **kwargs)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)

    return inner


def words_of(text: bytes) -> list[bytes]:
    """Words between white space, with A-Z in lower case (bytes.lower and bytes.split know ASCII only)."""
    return text.lower().split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(h: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of `width` consecutive values; the whole sequence is one run when it is shorter."""
    if not len(h):
        return h
    width = min(width, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def ragged(values: np.ndarray, counts: np.ndarray | list[int], kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each list."""
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values).cast(kind))


#: A side of a join may be sent to every executor when it was counted and has at most so many narrow rows (some 30 MB).
SENT_ROWS = 500_000


def sent_if_small(side: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """Mark a written table of narrow rows for broadcast when its row count allows it; beyond that the join shuffles."""
    return F.broadcast(side) if side.count() <= rows else side
