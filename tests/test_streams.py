"""Streams over several micro-batches give what the batch rule gives."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.plans import streams as P
from threadloom.sources.testviews import table
from threadloom.streaming import jobs as J


@pytest.fixture(scope="module")
def split_events(spark, sf, tmp_path_factory):
    """The events table as five files written one after the other in time order, so that the stream runs five batches."""
    folder = str(tmp_path_factory.mktemp("events"))
    numbered = table(spark, sf, "events").withColumn("part", F.ntile(5).over(Window.orderBy("ts"))).cache()
    for part in range(1, 6):
        numbered.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)
    return folder


def stream(spark, folder):
    schema = spark.read.parquet(folder).schema
    return J.read_stream(spark, folder, "*.parquet", schema, files_per_trigger=1)


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_newest(spark, sf, split_events):
    got = J.stream_newest(P.captures(stream(spark, split_events)), J.fresh(spark, "t"))
    assert rows(got, "conversation_id", "capture_id") == rows(J.newest(P.captures(table(spark, sf, "events"))), "conversation_id", "capture_id")


def test_metered(spark, sf, split_events):
    shape = lambda e: e.selectExpr("user_id", "ts", "event_type AS metric", "1L AS amount")
    got = J.stream_metered(shape(stream(spark, split_events)), J.fresh(spark, "t"))
    assert rows(got, "user_id", "period", "metric", "count") == rows(J.metered(shape(table(spark, sf, "events"))), "user_id", "period", "metric", "count")


def test_limiter_stream_equals_batch_and_plain_loop(spark, sf, split_events):
    batch = J.limited(P.requests(spark, table(spark, sf, "events"))).cache()
    # Files are read oldest first; the batches are in time order.
    streamed = J.stream_limited(P.requests(spark, stream(spark, split_events)), J.fresh(spark, "t"))
    assert rows(streamed, "user_id", "request_id", "allowed", "remaining") == rows(batch, "user_id", "request_id", "allowed", "remaining")
    state, want = {}, {}
    ask = P.requests(spark, table(spark, sf, "events")).orderBy("ts", "request_id").collect()
    for r in ask:
        if r.requests_per_hour == J.UNLIMITED:
            want[r.request_id] = True
            continue
        capacity, now = r.requests_per_hour + r.burst_size, r.ts.timestamp()
        tokens, last = state.get(r.user_id, (float(capacity), now))
        tokens = min(capacity, tokens + (now - last) * r.requests_per_hour / 3600)
        want[r.request_id] = tokens >= 1
        state[r.user_id] = (tokens - 1 if tokens >= 1 else tokens, now)
    assert {r.request_id: r.allowed for r in batch.collect()} == want


def test_limiter_denies_when_empty(spark):
    now = datetime(2024, 1, 1)
    data = [(1, i, now + timedelta(seconds=i), 0, 1) for i in range(2)]
    asked = spark.createDataFrame(data, "user_id bigint, request_id bigint, ts timestamp, requests_per_hour int, burst_size int")
    assert [r.allowed for r in J.limited(asked).orderBy("request_id").collect()] == [True, False]


def test_a_peek_takes_nothing(spark):
    now = datetime(2024, 1, 1)
    data = [(1, i, now + timedelta(seconds=i), 0, 2, i == 1) for i in range(4)]
    asked = spark.createDataFrame(data, "user_id bigint, request_id bigint, ts timestamp, requests_per_hour int, burst_size int, peek boolean")
    got = J.limited(asked).orderBy("request_id").collect()
    assert [(r.allowed, r.remaining, r["limit"]) for r in got] == [(True, 1, 2), (True, 1, 2), (True, 0, 2), (False, 0, 2)]
    assert got[-1].reset_in_seconds == got[-1].retry_after == float("inf")
    streamed = J._verdicts(pd.DataFrame([(1, i, 0, 2, float(i), i == 1) for i in range(4)], columns=["user_id", "request_id", "requests_per_hour", "burst_size", "seconds", "peek"]), ((None,), 0.0, None))
    assert list(streamed[0]["allowed"]) == [True, True, True, False]


def test_health(spark, sf, split_events):
    got = J.stream_delivery_health(P.hooks(stream(spark, split_events)), J.fresh(spark, "t"))
    want = J.delivery_health(P.hooks(table(spark, sf, "events")))
    assert rows(got, "event_id", "failure_count", "is_active") == rows(want, "event_id", "failure_count", "is_active")


def test_changes(spark, sf, split_events):
    got = J.stream_changed_counts(P.captures(stream(spark, split_events)), J.fresh(spark, "t"))
    want = J.changed_counts(P.captures(table(spark, sf, "events")))
    assert rows(got, "capture_id", "message_count") == rows(want, "capture_id", "message_count")


def test_connections_end_with_the_clock(spark, sf, split_events):
    want = J.dropped_connections(P.beats(table(spark, sf, "events")))
    path = J.fresh(spark, "t")
    before = {(r.connection_id, r.last_seen) for r in J.stream_connections(P.beats(stream(spark, split_events)), path).collect()}
    last = P.beats(table(spark, sf, "events")).agg(F.max("ts").alias("ts")).first().ts
    now = last + timedelta(seconds=J.STALE_SECONDS + 60)
    after = [(r.connection_id, r.last_seen) for r in J.stream_connections(P.beats(stream(spark, split_events)), path, now=now).collect()]
    silent = {(r.connection_id, r.last_seen) for r in want.collect()}
    # Without a tick the newest sessions stay open; with it every session ends, each once.
    assert before < silent and set(after) == silent and len(after) == len(silent)


def test_sessions_join_whatever_the_order():
    at = np.array([500, 0, 100, 221, 900], dtype=np.int64) * 1_000_000
    one = np.ones(5, dtype=np.int64)
    starts, ends, beats = J._sessions(at, at, one)
    assert list(starts // 1_000_000) == [0, 221, 500, 900] and list(ends // 1_000_000) == [100, 221, 500, 900] and list(beats) == [2, 1, 1, 1]


def test_months_close_and_late_rows_become_corrections(spark, tmp_path):
    schema = "user_id bigint, ts timestamp, metric string, amount bigint"
    day = lambda m, d: datetime(2024, m, d, 12)
    batches = [
        [(1, day(1, 5), "shifts", 2), (2, day(1, 30), "shifts", 1), (1, day(1, 6), J.LIFETIME, 1)],
        [(1, day(2, 2), "shifts", 4), (2, day(1, 31), "shifts", 1)],
        [(1, day(2, 10), "shifts", 1)],
        [(1, day(1, 7), "shifts", 10), (1, day(3, 20), "shifts", 8), (None, None, None, None)],
    ]
    folder, path = str(tmp_path / "usage"), J.fresh(spark, "t")
    closed = []
    for rows_ in batches:
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(folder)
        got = J.stream_metered(J.read_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema), path)
        closed.append({r.period for r in spark.read.schema(J.CLOSED).parquet(f"{path}/closed").collect()} if len(closed) > 1 else set())
        assert rows(got, "user_id", "period", "metric", "count") == rows(J.metered(spark.read.parquet(folder)), "user_id", "period", "metric", "count")
    # January is over once February is past the delay; its late row is a correction and the closed rows stay as they were.
    assert closed[2] == {"2024-01"} and closed[3] == {"2024-01", "2024-02"}
    late = J.corrections(spark, path).collect()
    assert [(r.user_id, r.period, r["count"]) for r in late] == [(1, "2024-01", 10)]
    # A replayed batch changes nothing.
    before = rows(J.counters(spark, path), "user_id", "period", "metric", "count")
    J._meter(spark.createDataFrame(batches[3], schema), 3, path, "3 days")
    assert rows(J.counters(spark, path), "user_id", "period", "metric", "count") == before


def test_distinct_messages_stream(spark, split_events):
    got = J.stream_distinct_messages(P.identified(stream(spark, split_events)), J.fresh(spark, "t"), "400 days")
    assert got.count() == got.select("identity").distinct().count() == P.identified(spark.read.parquet(split_events)).select("identity").distinct().count()
    assert F is not None


@pytest.mark.parametrize("parts", (1, 3))
def test_tables_of_one_or_many_files(spark, tmp_path, parts):
    """A table may be one file or a folder of files; a stream reads all of it."""
    said = [(c, t, "user", f" words {c} {t} ") for c in range(4) for t in range(5)]
    made = spark.createDataFrame(said, "conv_id bigint, turn int, role string, text string").repartition(parts)
    if parts > 1:
        made.write.parquet(str(tmp_path / "conversations.parquet"))
    else:
        made.toPandas().to_parquet(tmp_path / "conversations.parquet", index=False)
    got = {(r["conv_id"], r["full_text"]) for r in P.stream_normalized(spark, str(tmp_path)).collect()}
    assert got == {(f"{c}:{t}", text.strip()) for c, t, _, text in said}
    assert P.stream_sanitized(spark, str(tmp_path)).count() == len(said)
