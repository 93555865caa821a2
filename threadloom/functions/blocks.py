"""Rows in blocks, and every block of one table with every block of another, without a shuffle.

A block is one row that holds some rows as an Arrow stream.  Both tables are written once as blocks; a task reads the blocks of a
stretch of the one table one after another and meets each with the few blocks of the other that it holds, so disk grows with the
rows, not with their pairs, and a task holds a few blocks whatever the tables' sizes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import shared_folder

#: Bytes of a block at most, beyond its first row, and blocks of a file at most.
BLOCK_BYTES = 4 << 20
FILE_BLOCKS = 8
SCHEMA = "no bigint, rows bigint, bytes bigint, block binary"
SCHEMA_NAMES = ["no", "rows", "bytes", "block"]
#: Tasks for each core that pairs of blocks are dealt to, as far as there are blocks.
TASKS = 3


def _packer(size: int, by: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = TaskContext.get().partitionId() << 33
        held, count, weight, last = [], 0, 0, None

        def block() -> pa.RecordBatch:
            table, sink = pa.Table.from_batches(held).combine_chunks(), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            body = sink.getvalue().to_pybytes()
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (no, count, len(body))), pa.array([body], pa.binary())], SCHEMA_NAMES)

        for batch in batches:
            n = batch.num_rows
            values = batch.column(by).to_numpy(zero_copy_only=False) if by else np.zeros(n)
            each = max(1, batch.nbytes // max(1, n))
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), n]):
                if held and values[a : a + 1] != last:
                    yield block()
                    held, count, weight, no = [], 0, 0, no + 1
                last = values[a : a + 1]
                while a < b:
                    some = min(b - a, size - count, max(1, (BLOCK_BYTES - weight) // each))
                    held.append(batch.slice(a, some))
                    a, count, weight = a + some, count + some, weight + some * each
                    if count >= size or weight >= BLOCK_BYTES:
                        yield block()
                        held, count, weight, no = [], 0, 0, no + 1
        if held:
            yield block()

    return pack


def _written(blocks: DataFrame, purpose: str) -> DataFrame:
    spark, path = blocks.sparkSession, shared_folder(blocks.sparkSession, purpose)
    blocks.write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(path)
    return spark.read.schema(blocks.schema).parquet(path)


def packed(rows: DataFrame, purpose: str, size: int, by: str | None = None) -> DataFrame:
    """Blocks (no, rows, bytes, block): the rows of each partition, at most `size` in a block, written once.

    With `by`, a column of numbers by which partitions are sorted, a block holds rows of one value.  Without it, the blocks of many
    small partitions are put together and written again.
    """
    pack = _packer(size, by)
    blocks = _written(rows.mapInArrow(pack, SCHEMA), purpose)
    if by:
        return blocks
    there = blocks.agg(F.count("*").alias("n"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).first()
    fewest = max(-(-(there["rows"] or 0) // size), -(-(there["bytes"] or 0) // BLOCK_BYTES), 1)
    if there["n"] <= 2 * fewest + 8:
        return blocks

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack(b for batch in batches for block in batch.column("block") for b in rows_of(block).to_batches())

    return _written(blocks.coalesce(fewest).mapInArrow(again, SCHEMA), purpose)


def rows_of(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


Pairs = Iterator[tuple[int, pa.Scalar, int, pa.Scalar]]


def in_pairs(streamed: DataFrame, held: DataFrame, meet: Callable[[Pairs], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """meet(pairs) in every task, over (number, block) of `streamed` and (number, block) of `held`; see rows_of().

    The pairs of all tasks are all pairs.  A streamed block meets the held ones of its task one after another, and a task holds
    one block of `held`, or a few if their numbers let partitions fall together.
    """
    spark = streamed.sparkSession
    wide, parts = streamed.count(), held.count()
    cut = min(wide, -(-TASKS * spark.sparkContext.defaultParallelism // max(1, parts)))
    left = streamed.select(F.col("no").alias("a_no"), F.col("block").alias("a"))
    left = left.coalesce(1) if cut <= 1 else left.repartition(cut)
    right = held.select(F.col("no").alias("b_no"), F.col("block").alias("b")).repartition(max(1, parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Pairs:
            for batch in batches:
                a_no, a, b_no, b = batch.columns
                for i in range(batch.num_rows):
                    yield a_no[i].as_py(), a[i], b_no[i].as_py(), b[i]

        yield from meet(pairs())

    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(run, schema)
