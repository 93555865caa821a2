"""Counting inside rows: values of an array, and rows whose id is their own apart from those whose id comes again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.barrier import once
from threadloom.session import saved

#: Repeated ids are sent to all tasks up to this number; beyond it the split shuffles.
SENT_IDS = 500_000


def by_repetition(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key no other row has, the rest or None if there is none); null is a key like others.

    Only the keys are shuffled to find out.
    """
    again = saved(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("__again")), "repeated")
    n = again.count()
    if n == 0:
        return rows, None
    again = F.broadcast(again) if n <= SENT_IDS else again
    same = F.col(key).eqNullSafe(F.col("__again"))
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """The array column as sorted array of (value, n), null first; linear after one sort inside the row."""
    rest = [c for c in rows.columns if c != column]
    in_order = once(rows.select(*rest, column), __s=F.sort_array(column)).select(*rest, "__s")
    starts = F.filter(
        F.transform("__s", lambda v, i: F.when((i == 0) | ~v.eqNullSafe(F.get("__s", i - 1)), i)), lambda i: i.isNotNull()
    )
    placed = once(in_order, __at=starts)
    counted = F.transform(
        "__at",
        lambda at, i: F.struct(
            F.get("__s", at).alias("value"), (F.coalesce(F.get("__at", i + 1), F.size("__s")) - at).cast("bigint").alias("n")
        ),
    )
    return placed.select(*rest, counted.alias(column))
