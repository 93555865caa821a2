"""Structured Streaming jobs for the stateful event behaviours, and the batch form of each rule.

Sinks are files under a caller-given path: every output survives the loss of an executor and can be read by any job.
Stateful operators use transformWithState on the RocksDB store; state per key is a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from threadloom.functions import ordered
from threadloom.operators import safety, stores
from threadloom.session import shared_folder
from threadloom.sources import dialects

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LIFETIME = "consensus_trials"
MAX_FAILURES = 10
STALE_SECONDS = 120
UNLIMITED = -1


def read_stream(spark: SparkSession, folder: str, name: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A file stream over the files of one name in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def run_available(writer) -> None:
    """Process what is there, then stop."""
    spark = SparkSession.active()
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        # A query copies the settings of its session when it starts.
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()


def to_files(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Append-mode file sink with its own checkpoint."""
    writer = stream.writeStream.outputMode(mode).format("parquet")
    run_available(writer.option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint"))


def to_batches(stream: DataFrame, path: str, shape=None, mode: str = "update") -> None:
    """Write every micro-batch to its own folder; a replayed batch overwrites its own folder, so nothing doubles."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if shape is None else shape(batch)
        rows.write.mode("overwrite").parquet(f"{path}/data/batch_id={batch_id}")

    run_available(
        stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint")
    )


# -- capture queue: the newest capture of a conversation replaces older ones -------------------------------------------------


def newest(captures: DataFrame) -> DataFrame:
    rest = [c for c in captures.columns if c != "conversation_id"]
    best = captures.groupBy("conversation_id").agg(
        F.max_by(F.struct(*rest), F.struct("captured_at", "capture_id")).alias("c")
    )
    return best.select("conversation_id", "c.*")


def stream_newest(captures: DataFrame, path: str, buckets: int = stores.BUCKETS) -> DataFrame:
    """A store of one row per conversation: a micro-batch replaces the buckets of its conversations; readers only scan."""

    def write(batch: DataFrame, batch_id: int) -> None:
        stores.merge(batch, f"{path}/data", ["conversation_id"], newest, buckets)

    run_available(captures.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint"))
    return stores.bucket_rows(captures.sparkSession, f"{path}/data", captures.schema)


# -- change suppression: pass a capture on only when its message count changed --------------------------------------------------


def changed_counts(captures: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    bucket = F.floor(F.unix_seconds(F.col("captured_at").cast("timestamp")) / bucket_seconds)
    paired = ordered.previous(
        captures, ["conversation_id"], ["captured_at", "capture_id"], ["message_count"], bucket, "before"
    )
    same = F.col("before.message_count").eqNullSafe(F.col("message_count"))
    return paired.where(F.col("before").isNull() | ~same).drop("before")


class _ChangedCounts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "n BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # One micro-batch of one conversation; captures arrive in any order inside it.
        batch = pd.concat(list(rows)).sort_values(["captured_at", "capture_id"], kind="stable")
        stored = self.last.get()[0] if self.last.exists() else None
        before = batch["message_count"].shift().astype("Float64")
        if stored is not None:
            before.iloc[0] = stored
        self.last.update((int(batch["message_count"].iloc[-1]),))
        yield batch[before.isna() | (before != batch["message_count"])][["conversation_id", "capture_id", "captured_at", "message_count"]]

    def close(self) -> None:
        pass


def stream_changed_counts(captures: DataFrame, path: str) -> DataFrame:
    out = captures.groupBy("conversation_id").transformWithStateInPandas(
        statefulProcessor=_ChangedCounts(),
        outputStructType="conversation_id bigint, capture_id bigint, captured_at timestamp, message_count bigint",
        outputMode="Append",
        timeMode="None",
    )
    to_files(out, path)
    return captures.sparkSession.read.parquet(f"{path}/data")


# -- message dedup ----------------------------------------------------------------------------------------------------------------


def stream_distinct_messages(messages: DataFrame, path: str, delay: str = "1 day") -> DataFrame:
    """messages(identity, ts, ...): later copies of an identity are dropped; state older than the delay is freed."""
    to_files(messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["identity"]), path)
    return messages.sparkSession.read.parquet(f"{path}/data")


# -- usage metering --------------------------------------------------------------------------------------------------------------


def metered(usage: DataFrame) -> DataFrame:
    """Counter per user, month and metric; lifetime metrics share one period."""
    period = F.when(F.col("metric") == LIFETIME, "lifetime").otherwise(F.date_format("ts", "yyyy-MM"))
    return usage.groupBy("user_id", period.alias("period"), "metric").agg(F.sum("amount").alias("count"))


_COUNTER = [StructField("user_id", LongType()), StructField("metric", StringType()), StructField("count", LongType())]
LEDGER = StructType([*_COUNTER, StructField("period", StringType()), StructField("batch", LongType())])
CLOSED = StructType([*_COUNTER, StructField("through", LongType()), StructField("period", StringType())])
#: The newest event time (microseconds) after each micro-batch.
MARKS = StructType([StructField("high", LongType()), StructField("batch", LongType())])


def _months(after: pd.Timestamp, until: pd.Timestamp) -> list[str]:
    """The months that end after one moment and not after the other."""
    return [str(m) for m in pd.period_range(after, until, freq="M") if after < (m + 1).start_time <= until]


def _meter(batch: DataFrame, batch_id: int, path: str, delay: str) -> None:
    """One micro-batch of usage: its counters go to the ledger, months that are over go to the closed table."""
    spark = batch.sparkSession
    counted = metered(batch).select("user_id", "metric", "count", "period", F.lit(batch_id).cast("bigint").alias("batch"))
    stores.opened(spark, f"{path}/ledger", LEDGER)
    stores.replace_partitions(counted, f"{path}/ledger", "period", "batch")
    marks = stores.opened(spark, f"{path}/marks", MARKS)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    seen = batch.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    before = marks.where(F.col("batch") < batch_id).agg(F.max("high").alias("high")).first().high
    high = max((t for t in (before, seen.high) if t is not None), default=None)
    if high is None:
        return
    stores.replace_partitions(spark.createDataFrame([(high, batch_id)], MARKS), f"{path}/marks", "batch")
    low = seen.low if before is None else before
    grace = pd.Timedelta(delay)
    over = _months(pd.Timestamp(low, unit="us") - grace, pd.Timestamp(high, unit="us") - grace)
    if over:
        ledger = stores.opened(spark, f"{path}/ledger", LEDGER).where(F.col("period").isin(over) & (F.col("batch") <= batch_id))
        closed = ledger.groupBy("user_id", "metric", "period").agg(F.sum("count").alias("count"))
        rows = closed.withColumn("through", F.lit(batch_id).cast("bigint"))
        stores.opened(spark, f"{path}/closed", CLOSED)
        stores.replace_partitions(rows.select(*CLOSED.fieldNames()), f"{path}/closed", "period")


def counters(spark: SparkSession, path: str) -> DataFrame:
    """Counter per user, period and metric: closed months as they lie, open months and corrections from the ledger."""
    closed = stores.opened(spark, f"{path}/closed", CLOSED)
    until = closed.groupBy("period").agg(F.max("through").alias("through"))
    ledger = stores.opened(spark, f"{path}/ledger", LEDGER).join(F.broadcast(until), "period", "left")
    rest = ledger.where(F.col("through").isNull() | (F.col("batch") > F.col("through")))
    both = closed.drop("through").unionByName(rest.select("user_id", "metric", "count", "period"))
    return both.groupBy("user_id", "period", "metric").agg(F.sum("count").alias("count"))


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """What arrived for a month after it was closed."""
    until = stores.opened(spark, f"{path}/closed", CLOSED).groupBy("period").agg(F.max("through").alias("through"))
    ledger = stores.opened(spark, f"{path}/ledger", LEDGER).join(F.broadcast(until), "period")
    return ledger.where(F.col("batch") > F.col("through")).select("user_id", "period", "metric", "count", "batch")


def stream_metered(usage: DataFrame, path: str, delay: str = "3 days") -> DataFrame:
    """Usage counters without streaming state.

    A micro-batch is counted and laid into a ledger by period and batch (a replay replaces its own partitions).  Once the
    newest event is `delay` past the end of a month, the month's counters are added up into the closed table, which says
    through which batch they count.  Later rows of a closed month stay in the ledger as corrections: nothing is dropped
    and no closed month is written again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        _meter(batch, batch_id, path, delay)

    run_available(usage.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint"))
    return counters(usage.sparkSession, path)


# -- token-bucket limiter ------------------------------------------------------------------------------------------------------------


def take(
    tokens: float, last: float | None, now: float, capacity: int, rate: float, peek: bool = False
) -> tuple[bool, float, float, float]:
    """One request against one bucket: (allowed, tokens left, new last time, seconds to wait).  A peek takes nothing."""
    if last is not None:
        # An event older than the last refill brings no refill.
        tokens = min(capacity, tokens + max(0.0, now - last) * rate)
        now = max(now, last)
    if tokens >= 1.0:
        return True, tokens if peek else tokens - 1.0, now, 0.0
    return False, tokens, now, (1.0 - tokens) / rate if rate > 0 else float("inf")


LIMITER_COLUMNS = (
    "user_id bigint, request_id bigint, allowed boolean, remaining bigint, limit bigint, reset_in_seconds double,"
    " retry_after double"
)


def _verdicts(batch: pd.DataFrame, state: tuple, piece: str | None = None) -> tuple[pd.DataFrame, tuple]:
    """Verdicts of rows in order; `state` is (what the bucket belongs to, tokens, last time) and travels along."""
    owner, tokens, last = state
    out = []
    for r in batch.itertuples():
        if r.requests_per_hour == UNLIMITED:
            out.append((r.user_id, r.request_id, True, UNLIMITED, UNLIMITED, 0.0, 0.0))
            continue
        capacity = int(r.requests_per_hour + r.burst_size)
        mine = (capacity,) if piece is None else (r.user_id, getattr(r, piece), capacity)
        if owner != mine:
            owner, tokens, last = mine, float(capacity), None
        ok, tokens, last, wait = take(tokens, last, r.seconds, capacity, r.requests_per_hour / 3600.0, bool(r.peek))
        out.append((r.user_id, r.request_id, ok, int(tokens) if ok else 0, capacity, wait, wait))
    names = [c.split()[0] for c in LIMITER_COLUMNS.split(", ")]
    return pd.DataFrame(out, columns=names), (owner, tokens, last)


class _Limiter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens DOUBLE, last DOUBLE, capacity BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["seconds", "request_id"], kind="stable")
        tokens, last, capacity = self.bucket.get() if self.bucket.exists() else (0.0, None, None)
        out, (owner, tokens, last) = _verdicts(batch, ((capacity,), tokens, last))
        if owner[0] is not None:
            self.bucket.update((tokens, last, owner[0]))
        yield out

    def close(self) -> None:
        pass


def _with_seconds(requests: DataFrame) -> DataFrame:
    timed = requests.withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).drop("ts")
    return timed if "peek" in timed.columns else timed.withColumn("peek", F.lit(False))


def stream_limited(requests: DataFrame, path: str) -> DataFrame:
    """requests(user_id, request_id, ts, requests_per_hour, burst_size[, peek]) -> verdict per request."""
    out = _with_seconds(requests).groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_Limiter(), outputStructType=LIMITER_COLUMNS, outputMode="Append", timeMode="None"
    )
    to_files(out, path)
    return requests.sparkSession.read.parquet(f"{path}/data")


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Requests sorted by (user, segment, time) in constant memory: the bucket travels along the sorted rows."""
    state = (None, 0.0, None)
    for batch in batches:
        out, state = _verdicts(batch, state, "segment")
        yield out


def limited(requests: DataFrame) -> DataFrame:
    """The limiter over stored requests; a row whose `peek` is true asks for the state of its bucket and takes nothing.

    A pause long enough to refill the bucket makes everything after it independent of what came before, so a user's
    requests are cut there and the pieces run in parallel.  Within a piece rows stream through a task in order.
    """
    timed = _with_seconds(requests)
    bucket = F.floor(F.col("seconds") / 86_400)
    paired = ordered.previous(timed, ["user_id"], ["seconds", "request_id"], ["seconds"], bucket, "before")
    rate = F.col("requests_per_hour") / F.lit(3600.0)
    pause = F.try_divide(F.col("requests_per_hour") + F.col("burst_size"), rate)
    starts = F.col("before").isNull() | (F.col("seconds") - F.col("before.seconds") >= pause)
    cut = paired.withColumn("starts", F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0)).drop("before")
    pieces = ordered.running_sum(cut, ["user_id"], ["seconds", "request_id"], F.col("starts"), bucket, "segment")
    placed = pieces.drop("starts").repartition("user_id", "segment").sortWithinPartitions(
        "user_id", "segment", "seconds", "request_id"
    )
    return placed.mapInPandas(_replay, LIMITER_COLUMNS)


# -- delivery health -----------------------------------------------------------------------------------------------------------------


def delivery_health(deliveries: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Consecutive failures after each delivery, and whether the hook is still active (ten in a row end it for good)."""
    order = ["ts", "event_id"]
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / bucket_seconds)
    runs = ordered.running_sum(
        deliveries, ["webhook_id"], order, F.when(F.col("success"), 1).otherwise(0), bucket, "run"
    )
    failed = F.when(F.col("success"), 0).otherwise(1)
    counted = ordered.running_sum(runs, ["webhook_id", "run"], order, failed, bucket, "failures")
    hit = F.when(F.col("failures") >= MAX_FAILURES, 1).otherwise(0)
    ended = ordered.running_sum(counted, ["webhook_id"], order, hit, bucket, "ended")
    return ended.select(
        "webhook_id", "event_id", F.col("failures").cast("bigint").alias("failure_count"), (F.col("ended") == 0).alias("is_active")
    )


class _DeliveryHealth(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.health = handle.getValueState("health", "failures BIGINT, active BOOLEAN")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        failures, active = self.health.get() if self.health.exists() else (0, True)
        counts, states = [], []
        for ok in batch["success"]:
            failures = 0 if ok else failures + 1
            active = active and failures < MAX_FAILURES
            counts.append(failures)
            states.append(active)
        self.health.update((failures, bool(active)))
        yield pd.DataFrame(
            {
                "webhook_id": batch["webhook_id"].to_numpy(),
                "event_id": batch["event_id"].to_numpy(),
                "failure_count": counts,
                "is_active": states,
            }
        )

    def close(self) -> None:
        pass


def stream_delivery_health(deliveries: DataFrame, path: str) -> DataFrame:
    out = deliveries.groupBy("webhook_id").transformWithStateInPandas(
        statefulProcessor=_DeliveryHealth(),
        outputStructType="webhook_id bigint, event_id bigint, failure_count bigint, is_active boolean",
        outputMode="Append",
        timeMode="None",
    )
    to_files(out, path)
    return deliveries.sparkSession.read.parquet(f"{path}/data")


# -- stale connections ------------------------------------------------------------------------------------------------------------------


def dropped_connections(beats: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    """Heartbeats after which a connection was silent for more than the limit, with the time it was dropped."""
    bucket = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / bucket_seconds)
    paired = ordered.following(beats, ["connection_id"], ["ts", "event_id"], ["ts"], bucket, "later")
    silent = F.unix_micros(F.col("later.ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    gone = paired.where(F.col("later").isNull() | (silent > STALE_SECONDS * 1_000_000))
    return gone.select("connection_id", F.col("ts").alias("last_seen"))


CONNECTIONS = "connection_id bigint, last_seen timestamp, beats bigint"
_LIMIT = STALE_SECONDS * 1_000_000


def _sessions(starts: np.ndarray, ends: np.ndarray, beats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Join intervals that are at most the limit apart (microseconds)."""
    order = np.argsort(starts, kind="stable")
    starts, reach, beats = starts[order], np.maximum.accumulate(ends[order]), beats[order]
    first = np.flatnonzero(np.concatenate([[True], starts[1:] - reach[:-1] > _LIMIT]))
    last = np.concatenate([first[1:] - 1, [len(starts) - 1]])
    return starts[first], reach[last], np.add.reduceat(beats, first)


class _Connections(StatefulProcessor):
    """Open sessions of a connection; an event-time timer ends a session once no beat can prolong it any more."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "start BIGINT, end BIGINT, beats BIGINT")

    def _keep(self, sessions, passed_ms: int) -> pd.DataFrame:
        """Store what is still open, set its timer, and return what is over."""
        starts, ends, beats = sessions
        # Rounded up to whole milliseconds; beats not after the watermark never arrive.
        expiry = -((-(ends + _LIMIT)) // 1000)
        over = expiry <= passed_ms
        left = [(int(a), int(b), int(n)) for a, b, n in zip(starts[~over], ends[~over], beats[~over])]
        if left:
            self.open.put(left)
            self.handle.registerTimer(int(expiry[~over].min()))
        else:
            self.open.clear()
        return pd.DataFrame({"end": ends[over], "beats": beats[over]})

    def _stored(self):
        rows = list(self.open.get()) if self.open.exists() else []
        columns = np.array([tuple(r) for r in rows], dtype=np.int64).reshape(-1, 3)
        return columns[:, 0], columns[:, 1], columns[:, 2]

    def _out(self, key, over: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "connection_id": [key[0]] * len(over),
                "last_seen": pd.to_datetime(over["end"].to_numpy(), unit="us", utc=True),
                "beats": over["beats"].to_numpy(),
            }
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            # Ticks only move the watermark.
            for _ in rows:
                pass
            return
        state = self._stored()
        for chunk in rows:
            at = chunk["us"].to_numpy(dtype=np.int64)
            one = np.ones(len(at), dtype=np.int64)
            state = _sessions(*[np.concatenate(c) for c in zip(state, (at, at, one))])
        over = self._keep(state, timerValues.getCurrentWatermarkInMs())
        if len(over):
            yield self._out(key, over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self._stored()
        if len(state[0]):
            over = self._keep(state, timerValues.getCurrentWatermarkInMs())
            if len(over):
                yield self._out(key, over)

    def close(self) -> None:
        pass


def _connections(beats: DataFrame, ticks: DataFrame, path: str, delay: str) -> None:
    # Connections and ticks are one event-time column, so either moves the watermark.
    both = beats.select("connection_id", F.col("ts").cast("timestamp").alias("ts")).unionByName(
        ticks.select(F.lit(None).cast("bigint").alias("connection_id"), "ts")
    )
    timed = both.withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    out = timed.groupBy("connection_id").transformWithStateInPandas(
        statefulProcessor=_Connections(), outputStructType=CONNECTIONS, outputMode="Append", timeMode="EventTime"
    )
    to_files(out, path)


def tick(spark: SparkSession, path: str, moment) -> None:
    """Tell the connection job what time it is: everything silent for the limit before that moment is over."""
    schema = StructType([StructField("ts", TimestampType())])
    spark.createDataFrame([(moment,)], schema).coalesce(1).write.mode("append").parquet(f"{path}/ticks")


def stream_connections(beats: DataFrame, path: str, delay: str = "10 seconds", now=None) -> DataFrame:
    """Ends of the sessions of connections, from heartbeats in event time.

    A session ends after the limit without a beat.  The watermark follows the newest beat of all connections and the ticks
    of `tick`, so a silent system closes its last sessions too: with `now` given, the beats that are there are worked off,
    then the clock moves to `now`, and all sessions silent for the limit before `now` minus `delay` end.
    """
    spark = beats.sparkSession
    ticks = StructType([StructField("ts", TimestampType())])
    stores.opened(spark, f"{path}/ticks", ticks)
    _connections(beats, spark.readStream.schema(ticks).parquet(f"{path}/ticks"), path, delay)
    if now is not None:
        tick(spark, path, now)
        _connections(beats, spark.readStream.schema(ticks).parquet(f"{path}/ticks"), path, delay)
    return spark.read.parquet(f"{path}/data")


# -- sanitize and normalize on arrival -----------------------------------------------------------------------------------------------------


def stream_sanitized(messages: DataFrame, path: str) -> DataFrame:
    to_files(safety.sanitize(messages), path)
    return messages.sparkSession.read.parquet(f"{path}/data")


def stream_normalized(exports: DataFrame, path: str, dialect: str) -> DataFrame:
    """A plain dialect normalized on arrival: the same narrow expressions as in batch."""
    _, said = dialects.normalize(exports, (dialect,))
    to_files(said.drop("blocks"), path)
    return exports.sparkSession.read.parquet(f"{path}/data")


def fresh(spark: SparkSession, name: str) -> str:
    """A new output folder."""
    return shared_folder(spark, name)
