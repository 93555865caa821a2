"""Evaluate an expensive column exactly once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator of exactly one row.

    The optimizer moves filters through projections and merges neighbouring projections by copying expressions; a JSON
    parse that ten later expressions and a filter refer to would then run eleven times per row.  Expressions do not move
    across a generator, so what is computed here is computed once.  It stays a narrow, pipelined operation.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
