"""Ordered operations (running sums, previous row, runs) that survive a hot key.

A window partitioned by a key puts the whole key into one task.  When a single conversation, user or source holds a
third of all rows that task never ends, and neither adaptive execution nor more executors help, because a window
partition is never split.  The functions here cut every key into *buckets* that follow the order column, run the window
inside (key, bucket), summarize each bucket to one row, combine those summaries with a second, tiny window, and join
the carried value back.  Results equal the plain window exactly.

`bucket` is a Column that never decreases along the order within a key, e.g. floor(turn / 1024) or a day number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_B = "__bucket"


def bucket_of(column, width: int) -> Column:
    return F.floor(F.col(column) / F.lit(width)).cast("bigint")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    values: dict[str, Column],
    bucket: Column,
    inclusive: bool = True,
) -> DataFrame:
    """Add, per name in `values`, the sum over the rows of the key up to this row (or strictly before it)."""
    keys = list(keys)
    staged = df.withColumns({f"__v_{n}": v for n, v in values.items()} | {_B: bucket})
    earlier = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(*keys, _B)
        .agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in values])
        .select(*keys, _B, *[F.sum(f"__t_{n}").over(earlier).alias(f"__t_{n}") for n in values])
    )
    upto = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    local = staged.withColumns({f"__v_{n}": F.sum(f"__v_{n}").over(inside) for n in values})
    zero = F.lit(0)
    joined = local.join(offsets, [*keys, _B], "left").withColumns(
        {n: F.coalesce(f"__v_{n}", zero) + F.coalesce(f"__t_{n}", zero) for n in values}
    )
    return joined.drop(_B, *[f"__v_{n}" for n in values], *[f"__t_{n}" for n in values])


def running_sum(df, keys, order, value: Column, bucket: Column, out: str, inclusive: bool = True) -> DataFrame:
    return running_sums(df, keys, order, {out: value}, bucket, inclusive)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    bucket: Column,
    out: str,
    step: int = 1,
) -> DataFrame:
    """Add a struct `out` with `columns` of the row before (step=1) or after (step=-1) within the key."""
    keys = list(keys)
    staged = df.withColumn(_B, bucket)
    payload = F.struct(*[F.col(c) for c in columns])
    rank = F.struct(*[F.col(c) for c in order])
    edge = F.max_by(payload, rank) if step == 1 else F.min_by(payload, rank)
    across = Window.partitionBy(*keys).orderBy(_B if step == 1 else F.col(_B).desc())
    carried = (
        staged.groupBy(*keys, _B)
        .agg(edge.alias("__edge"))
        .withColumn("__carried", F.lag("__edge").over(across))
        .select(*keys, _B, "__carried")
    )
    direction = [F.col(c).asc() if step == 1 else F.col(c).desc() for c in order]
    inside = Window.partitionBy(*keys, _B).orderBy(*direction)
    local = staged.withColumn("__near", F.lag(payload).over(inside))
    return (
        local.join(carried, [*keys, _B], "left")
        .withColumn(out, F.coalesce("__near", "__carried"))
        .drop("__near", "__carried", _B)
    )


def following(df, keys, order, columns, bucket, out) -> DataFrame:
    return previous(df, keys, order, columns, bucket, out, step=-1)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows per key.

    Spark turns `row_number <= n` into a partial group limit before the shuffle, so a task sends at most n rows per
    key and a hot key costs n rows per map task, not all of its rows.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(by)).where(F.col(rank) <= n)
