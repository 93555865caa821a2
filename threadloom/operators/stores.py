"""Stored tables that are merged in place: rows lie in partitions by a hash of their key, and a merge replaces only the
partitions that its keys touch.

`partitionOverwriteMode=dynamic` writes to a staging folder and swaps whole partitions on commit, so a lost executor only
repeats tasks and a partition may be read and replaced by the same job.  Every merge may be repeated with the same input
(a replayed micro-batch) without changing the result.  A store has one writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from threadloom.operators import versions
from threadloom.session import saved

BUCKETS = 64


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def with_columns(schema: StructType, **types) -> StructType:
    return StructType([f for f in schema.fields if f.name not in types] + [StructField(n, t) for n, t in types.items()])


def opened(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a stored table; the folder is created where it is missing.  `schema` includes the partition columns."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def touched(rows: DataFrame) -> list[int]:
    """The numbers of the buckets that rows fall into: never more than the store has buckets."""
    return [r.bucket for r in rows.select("bucket").distinct().collect()]


def replace_partitions(rows: DataFrame, path: str, *partition_by: str) -> None:
    """Swap exactly the partitions that occur in `rows`; large partitions are split over several files."""
    even = rows.hint("rebalance", *partition_by)
    even.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def merge(arriving: DataFrame, path: str, keys: list[str], reduce: Callable[[DataFrame], DataFrame], buckets: int = BUCKETS) -> None:
    """Merge rows into a store of one row per key: `reduce` maps rows to one row per key, whatever the order and repetition."""
    spark, columns = arriving.sparkSession, arriving.columns
    stored = opened(spark, path, with_columns(arriving.schema, bucket=IntegerType()))
    mine = reduce(arriving).select(*columns).withColumn("bucket", bucket_of(keys, buckets))
    mine = mine.persist()
    try:
        old = stored.where(F.col("bucket").isin(touched(mine)))
        merged = reduce(old.unionByName(mine).drop("bucket")).select(*columns)
        replace_partitions(merged.withColumn("bucket", bucket_of(keys, buckets)), path, "bucket")
    finally:
        mine.unpersist()


def bucket_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return opened(spark, path, with_columns(schema, bucket=IntegerType())).drop("bucket")


# -- versioned rows: heads that are replaced, history that is only added to ----------------------------------------------------


def _store(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    heads = opened(spark, f"{path}/heads", with_columns(schema, batch=LongType(), bucket=IntegerType()))
    past = opened(
        spark, f"{path}/history", with_columns(schema, batch=LongType(), superseded_by=LongType(), bucket=IntegerType())
    )
    return heads, past


def append_batch(arriving: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> None:
    """Add new versions: arriving(session_id, arrival, ...) get the numbers that follow those of their session.

    The newest version of a session is a row of `heads`; older ones are rows of `history`, under the batch that superseded
    them.  A batch reads and replaces the heads of the buckets it touches and adds one history partition; the rows of older
    versions are never read or written again.

    Repeating a batch gives the same store: heads that the batch itself wrote are ignored, and those that it superseded
    are taken back from its own history partition.  Batches come in ascending order; only the last one may be repeated.
    """
    spark = arriving.sparkSession
    own = [f for f in arriving.schema.fields if f.name != "arrival"]
    schema = with_columns(StructType(own), version=LongType())
    heads, past = _store(spark, path, schema)
    columns = [*schema.fieldNames(), "batch", "bucket"]
    placed = arriving.withColumns({"batch": F.lit(batch).cast("bigint"), "bucket": bucket_of(["session_id"], buckets)})
    mine = F.col("bucket").isin(touched(placed)) & (F.col("batch") < batch)
    repeated = past.where(mine & (F.col("superseded_by") == batch))
    known = heads.where(mine).select(*columns).unionByName(repeated.select(*columns))
    before = versions.current_versions(known).select(*columns)
    flagged = saved(versions.append_versions(before, placed), "versions")
    old = flagged.where("NOT is_current").withColumn("superseded_by", F.lit(batch).cast("bigint")).drop("is_current")
    replace_partitions(old, f"{path}/history", "superseded_by", "bucket")
    replace_partitions(flagged.where("is_current").drop("is_current"), f"{path}/heads", "bucket")


def stored_versions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All versions with `is_current`, as they lie: a union of two scans, no join and no reduction."""
    heads, past = _store(spark, path, schema)
    names = schema.fieldNames()
    return heads.select(*names, F.lit(True).alias("is_current")).unionByName(
        past.select(*names, F.lit(False).alias("is_current"))
    )


def session_versions(spark: SparkSession, path: str, schema: StructType, session_id, buckets: int = BUCKETS) -> DataFrame:
    """All versions of one session: the bucket number prunes both scans to one partition of each batch."""
    literal = F.lit(session_id).cast(schema["session_id"].dataType)
    number = F.pmod(F.xxhash64(literal), F.lit(buckets)).cast("int")
    heads, past = _store(spark, path, schema)
    names = schema.fieldNames()
    one = (F.col("bucket") == number) & (F.col("session_id") == literal)
    return heads.where(one).select(*names, F.lit(True).alias("is_current")).unionByName(
        past.where(one).select(*names, F.lit(False).alias("is_current"))
    )
