"""All pairs of the rows of a key, in tiles.

The rows of a key are dealt into blocks whose number follows from their count, and the triangle of block pairs is the shuffle
key: a tile holds at most two blocks, whatever the size of the key, and every pair of rows meets in exactly one tile.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block on average.
BLOCK_ROWS = 256
#: Distinct values that are compared at once: bounds the memory of a tile of long sets.
CHUNK = 8_192


def in_tiles(
    rows: DataFrame, keys: Sequence[str], item: str, meet: Callable[[pa.Table, np.ndarray, np.ndarray], pa.Table], schema: str
) -> DataFrame:
    """Call meet(table, left, right) once per tile; left and right are row numbers, the same ones in a tile on the diagonal.

    `item` tells the rows of a key apart.  The table has the columns of `rows`; the result has `schema`.
    """
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("__blocks"))
    dealt = rows.join(sizes, keys).withColumn("__block", F.pmod(F.xxhash64(item), F.col("__blocks")))
    others = F.sequence(F.lit(0).cast("bigint"), F.col("__blocks") - 1)
    copies = dealt.withColumn("__other", F.explode(others)).withColumns(
        {"__a": F.least("__block", "__other"), "__b": F.greatest("__block", "__other")}
    )
    columns = rows.columns

    def tile(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, a, b = (table.column(c).to_numpy() for c in ("__block", "__a", "__b"))
        return meet(table.select(columns), np.flatnonzero(block == a), np.flatnonzero(block == b))

    # A row that meets its own block is there once.
    return copies.select(*columns, "__block", "__a", "__b").groupBy(*keys, "__a", "__b").applyInArrow(tile, schema)


def incidence(sets: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, list]:
    """Owner row and code of every element of a column of sets, and the values of the codes; null is an empty set."""
    sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
    sizes = sets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = sets.flatten().dictionary_encode()
    return np.repeat(np.arange(len(sizes)), sizes), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def common_counts(owner: np.ndarray, code: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many elements each left row shares with each right row; a row shares all of its own with itself."""
    shared = np.flatnonzero(np.bincount(code) > 1) if len(code) else code
    place = np.full(int(code.max()) + 1 if len(code) else 0, -1)
    place[shared] = np.arange(len(shared))
    at = place[code]
    sizes = np.bincount(owner, minlength=n)
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(shared), CHUNK):
        a, b = np.searchsorted(at, [start, start + CHUNK])
        held = np.zeros((n, min(CHUNK, len(shared) - start)), np.float32)
        held[owner[a:b], at[a:b] - start] = 1
        common += held[left] @ held[right].T
    if np.array_equal(left, right):
        np.fill_diagonal(common, sizes[left])
    return common
