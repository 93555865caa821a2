"""Stores that are merged in place: touched partitions only, replays, equality with the plain rule."""

import os

import pytest
from pyspark.sql.types import LongType

from threadloom.operators import stores
from threadloom.operators import versions as V
from threadloom.session import shared_folder
from threadloom.streaming import jobs as J

ARRIVING = "session_id bigint, arrival bigint, title string"


def files(path):
    return {
        os.path.join(root, f): os.path.getmtime(os.path.join(root, f))
        for root, _, names in os.walk(path) for f in names if f.endswith(".parquet")
    }


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def store(spark):
    path = shared_folder(spark, "t")
    first = spark.createDataFrame([(s, a, f"{s}/{a}") for s in range(200) for a in range(1, 1 + s % 4)], ARRIVING)
    stores.append_batch(first, path, 0, 16)
    schema = stores.with_columns(first.drop("arrival").schema, version=LongType())
    return path, first, schema


def plain(spark, *batches):
    """All batches by the rule over whole tables."""
    out = spark.createDataFrame([], "session_id bigint, title string, version bigint")
    for b in batches:
        out = V.append_versions(out, b).drop("is_current")
    newest = out.groupBy("session_id").agg({"version": "max"}).withColumnRenamed("max(version)", "n")
    return out.join(newest, "session_id").selectExpr("session_id", "title", "version", "version = n AS is_current")


def test_appends_equal_the_rule_over_whole_tables(spark, store):
    path, first, schema = store
    second = spark.createDataFrame([(3, 1, "x"), (3, 2, "y"), (0, 1, "new"), (777, 1, "z")], ARRIVING)
    stores.append_batch(second, path, 1, 16)
    got = stores.stored_versions(spark, path, schema).select("session_id", "title", "version", "is_current")
    want = as_rows(plain(spark, first, second))
    assert as_rows(got) == want
    # The same batch again, as after a lost driver.
    stores.append_batch(second, path, 1, 16)
    again = stores.stored_versions(spark, path, schema).select("session_id", "title", "version", "is_current")
    assert as_rows(again) == want
    one = stores.session_versions(spark, path, schema, 3, 16)
    assert sorted(r.version for r in one.collect()) == [1, 2, 3, 4, 5] and [r.title for r in one.collect() if r.is_current] == ["y"]


def test_an_append_rewrites_only_touched_heads_and_no_history(spark, store):
    path, _, schema = store
    before = files(path)
    second = spark.createDataFrame([(3, 1, "x"), (7, 1, "y")], ARRIVING)
    hit = {r.b for r in second.select(stores.bucket_of(["session_id"], 16).alias("b")).collect()}
    stores.append_batch(second, path, 1, 16)
    after = files(path)
    gone = {f for f in before if after.get(f) != before[f]}
    assert gone and all(f"/heads/bucket={b}/" in f for f in gone for b in [int(f.split("bucket=")[1].split("/")[0])] if b in hit)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in gone} <= hit
    assert not any("/history/superseded_by=0/" in f for f in gone)
    plan = stores.stored_versions(spark, path, schema)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_pruning_of_one_session(spark, store):
    path, _, schema = store
    plan = stores.session_versions(spark, path, schema, 7, 16)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_null_keys_and_empty_batches(spark):
    path = shared_folder(spark, "t")
    none = spark.createDataFrame([], ARRIVING)
    stores.append_batch(none, path, 0, 4)
    captures = spark.createDataFrame(
        [(1, 1, 5), (1, 2, 6), (None, 3, 7), (None, 4, 8)], "conversation_id bigint, capture_id bigint, n bigint"
    ).selectExpr("*", "timestamp'2024-01-01' AS captured_at")
    target = shared_folder(spark, "t")
    for _ in range(2):
        stores.merge(captures, target, ["conversation_id"], J.newest, 4)
    got = stores.bucket_rows(spark, target, captures.schema)
    assert sorted((r.conversation_id or -1, r.capture_id, r.n) for r in got.collect()) == [(-1, 4, 8), (1, 2, 6)]


def test_a_merge_leaves_other_buckets_alone(spark):
    target = shared_folder(spark, "t")
    rows = spark.range(100).selectExpr("id AS conversation_id", "1L AS capture_id", "timestamp'2024-01-01' AS captured_at")
    stores.merge(rows, target, ["conversation_id"], J.newest, 16)
    before = files(target)
    stores.merge(rows.where("conversation_id = 5").selectExpr("conversation_id", "2L AS capture_id", "captured_at"), target, ["conversation_id"], J.newest, 16)
    after = files(target)
    assert len({f.split("bucket=")[1].split("/")[0] for f in before if f not in after}) == 1
    assert stores.bucket_rows(spark, target, rows.schema).where("capture_id = 2").count() == 1
