"""Event streams: source, task lifecycles with a time limit, at-most-once receipts, incremental audits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from claimgrid.rules import values as V
from claimgrid.session import shared_path
from claimgrid.sources.events import parse_events

STATUS_SCHEMA = "task_id string, attempt bigint, status string, seconds double, polls bigint"
STATE_SCHEMA = "dispatches bigint, terminals bigint, completions bigint, polls bigint, start_us bigint, finish_us bigint, first_poll_us bigint, last_poll_us bigint, first_us bigint, closed_ms bigint"
WAIT_SECONDS, KEEP_SECONDS, LATE_SECONDS = 86_400, 7 * 86_400, 3_600
CLOSING = "\x00closing"
END_OF_TIME = "9999-01-01 00:00:00"


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """Log folder as a stream; malformed lines are kept with their text in ``bad``."""
    return parse_events(spark.readStream.text(path))


class AttemptProcessor(StatefulProcessor):
    """Per (task, attempt): a few numbers of state, and one verdict when no more events of it can come.

    An attempt is open for ``wait`` seconds of event time from its first event, whatever that is. Then the verdict goes
    out and a mark that the attempt is closed stays for ``keep`` seconds: what comes later finds the mark and changes
    nothing, so there is no second verdict. A second timer clears the mark. A timer or a mark that the watermark has
    passed already is not stored: such an attempt gets its verdict at once.

    Counts and mark are one value of state and the time of the timer follows from it, as each call of the state costs a
    round trip. The input is already combined per minute before the shuffle, so a busy task sends one row per minute
    here, whatever its number of events.
    """

    def __init__(self, limit: int, wait: int = WAIT_SECONDS, keep: int = KEEP_SECONDS):
        self.limit, self.wait, self.keep = limit, wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempt", STATE_SCHEMA)

    @staticmethod
    def _least(a, b):
        return b if a is None else a if b is None else min(a, b)

    @staticmethod
    def _most(a, b):
        return b if a is None else a if b is None else max(a, b)

    def _due(self, s) -> int:
        return int(s[8] // 1000) + self.wait * 1000

    def _verdict(self, key, s) -> Row:
        if s[0] != 1 or s[1] > 1:
            status = "not_one_dispatch_and_terminal"
        elif s[1] == 0:
            status = "timed_out"
        elif s[3] == 0 or s[6] < s[4] or s[7] > s[5]:
            status = "poll_missing_or_out_of_order"
        elif not 0 <= (s[5] - s[4]) / 1e6 <= self.limit:
            status = "duration_out_of_range"
        else:
            status = "completed" if s[2] else "failed"
        seconds = (s[5] - s[4]) / 1e6 if s[4] is not None and s[5] is not None else None
        return Row(task_id=str(key[0]), attempt=int(key[1]), status=status, seconds=seconds, polls=s[3])

    def _close(self, at: int, now: int, stored: bool) -> None:
        if at + self.keep * 1000 > now:
            self.state.update((0, 0, 0, 0, None, None, None, None, None, at))
            self.handle.registerTimer(at + self.keep * 1000)
        elif stored:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.state.get()
        if held is not None and held[9] is not None:
            for _ in rows:
                pass
            return iter(())
        s = list(held) if held is not None else [0, 0, 0, 0, None, None, None, None, None, None]
        for r in rows:
            s[0] += r.dispatches
            s[1] += r.terminals
            s[2] += r.completions
            s[3] += r.polls
            s[4] = self._least(s[4], r.start_us)
            s[5] = self._least(s[5], r.finish_us)
            s[6] = self._least(s[6], r.first_poll_us)
            s[7] = self._most(s[7], r.last_poll_us)
            s[8] = self._least(s[8], r.first_us)
        due, now = self._due(s), timerValues.getCurrentWatermarkInMs()
        before = self._due(held) if held is not None else None
        if before is not None and before != due:  # an earlier event has come
            self.handle.deleteTimer(before)
        if due <= now and before != due:  # a timer of this time would go off in this batch, after all rows of the attempt
            self._close(due, now, held is not None)
            return iter((self._verdict(key, s),))
        self.state.update(tuple(s))
        if before != due:
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self.state.get()
        if s is None:
            return
        if s[9] is not None:
            self.state.clear()
            return
        self._close(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs(), True)
        yield self._verdict(key, s)

    def close(self) -> None:
        pass


def attempt_stream(events: DataFrame, limit: int = V.TASK_SECONDS_MAX, late: str = f"{LATE_SECONDS} seconds", wait: int = WAIT_SECONDS, keep: int = KEEP_SECONDS) -> DataFrame:
    """Stream of attempt verdicts, one for each attempt. ``events``: task_id, attempt, event, ts (streaming).

    Step one is a one-minute window aggregation, combined before the shuffle; step two keeps the attempt
    state and gives the verdict by an event-time timer, ``wait`` seconds after the first event. Both share one watermark,
    which follows the latest event by ``late``; events behind it are dropped. Events without task, attempt or time are
    left out.
    """
    e, ts = F.col("event"), F.col("ts")
    us = F.unix_micros("ts")
    end = e.isin("completed", "failed")
    per_minute = (
        events.where("task_id is not null and attempt is not null").withWatermark("ts", late).groupBy(F.window("ts", "1 minute"), "task_id", "attempt").agg(
            F.count_if(e == "dispatched").alias("dispatches"), F.count_if(end).alias("terminals"), F.count_if(e == "completed").alias("completions"),
            F.count_if(e == "polled").alias("polls"), F.min(F.when(e == "dispatched", us)).alias("start_us"), F.min(F.when(end, us)).alias("finish_us"),
            F.min(F.when(e == "polled", us)).alias("first_poll_us"), F.max(F.when(e == "polled", us)).alias("last_poll_us"), F.min(us).alias("first_us")))
    flat = per_minute.select(F.window_time("window").alias("minute"), "task_id", "attempt", "dispatches", "terminals", "completions", "polls",
                             "start_us", "finish_us", "first_poll_us", "last_poll_us", "first_us")
    return flat.groupBy("task_id", "attempt").transformWithState(
        statefulProcessor=AttemptProcessor(limit, wait, keep), outputStructType=STATUS_SCHEMA, outputMode="Append", timeMode="EventTime")


EVENTS = "task_id string, attempt bigint, event string, ts timestamp"


def closed_attempts(spark: SparkSession, events: DataFrame, limit: int = V.TASK_SECONDS_MAX, late: str = f"{LATE_SECONDS} seconds", wait: int = WAIT_SECONDS, keep: int = KEEP_SECONDS) -> DataFrame:
    """Verdicts on all attempts of a log that has ended. ``events``: streaming; task_id, attempt, event, ts.

    The stream runs over what is there. Then a closing event, dated at the end of time, comes in by a second source, and
    the stream goes on from its checkpoint: the watermark passes every open window and timer, so that the attempts of the
    last days have their verdicts too. A log that goes on is read with ``attempt_stream`` alone.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    closing, out, state = (shared_path(spark, f"attempts-{n}") for n in ("closing", "verdicts", "state"))
    spark.createDataFrame([], EVENTS).write.parquet(closing)
    both = events.select("task_id", F.col("attempt").cast("bigint").alias("attempt"), "event", "ts").unionByName(spark.readStream.schema(EVENTS).parquet(closing))
    stream = attempt_stream(both, limit, late, wait, keep).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True)
    stream.start().awaitTermination()
    spark.createDataFrame([(CLOSING, 0, "closing")], "task_id string, attempt bigint, event string").withColumn("ts", F.lit(END_OF_TIME).cast("timestamp")).write.mode("append").parquet(closing)
    stream.start().awaitTermination()
    return spark.read.schema(STATUS_SCHEMA).parquet(out).where(F.col("task_id") != CLOSING)


IDENTITY = ["decision_sha256", "body_sha256", "channel"]


def first_receipts(receipts: DataFrame, out: str, state: str):
    """First sent receipt per identity, however late a repeat comes.

    The state store holds the first receipt of every identity. A batch touches the identities it brings, and nothing of
    what was written before is read. Of the receipts of one batch the one with the smallest time stamp, then the smallest
    other columns, counts. An identity is new when its first receipt arrived with this very batch. A batch that is run
    again after a failure has the same arrival time and replaces its own folder.
    """
    spark = receipts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rest = [c for c in receipts.columns if c not in (*IDENTITY, "ts")]
    sent = receipts.where("status = 'sent'").withColumn("_arrived", F.current_timestamp())
    first = sent.groupBy(*IDENTITY).agg(F.min(F.struct("_arrived", "ts", *rest)).alias("_r"), F.max("_arrived").alias("_last"))

    def one(batch: DataFrame, n: int) -> None:
        batch.where("_r._arrived = _last").select(*IDENTITY, "_r.*").drop("_arrived").write.mode("overwrite").parquet(f"{out}/batch={n}")

    return first.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start()


BUCKETS = 256


def project_bucket(key: str = "project_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def stored_lines(spark: SparkSession, out: str, schema: StructType, touched: DataFrame, n: int) -> DataFrame:
    """All lines of the touched projects' buckets up to batch ``n``. Only the folders of these buckets are listed and
    read; their numbers, no more than there are buckets, come to the driver."""
    held = sorted(r._bucket for r in touched.select("_bucket").distinct().collect())
    whole = StructType([*schema.fields, StructField("_bucket", IntegerType()), StructField("batch", LongType())])
    if not held:
        return spark.createDataFrame([], whole)
    lines = f"{out}/lines"
    return spark.read.schema(whole).option("basePath", lines).parquet(*[f"{lines}/_bucket={b}" for b in held]).where(F.col("batch") <= n)


def audit_new_projects(lines: DataFrame, checks: Callable[[DataFrame], DataFrame], out: str, state: str, buckets: int = BUCKETS):
    """Audit projects as their text arrives. The lines of a batch are stored by bucket of their project; then every project
    that the batch touches is audited whole, with all its stored lines. Only the buckets of these projects are read.
    ``current_findings`` reads the result.

    The batch number is part of the paths, so a batch that is run again after a failure replaces itself.
    """
    def one(batch: DataFrame, n: int) -> None:
        spark, key = batch.sparkSession, "project_id"
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        dealt = batch.withColumn("_bucket", project_bucket(key, buckets)).withColumn("batch", F.lit(n).cast("long"))
        dealt.repartition("_bucket").sortWithinPartitions("_bucket", key).write.mode("overwrite").partitionBy("_bucket", "batch").parquet(f"{out}/lines")
        batch.select(key).distinct().write.mode("overwrite").parquet(f"{out}/audited/batch={n}")
        touched = spark.read.schema(f"{key} {batch.schema[key].dataType.simpleString()}").parquet(f"{out}/audited/batch={n}").withColumn("_bucket", project_bucket(key, buckets))
        held = stored_lines(spark, out, batch.schema, touched, n)
        checks(held.join(touched.select(key), key, "left_semi").select(*batch.columns)).write.mode("overwrite").parquet(f"{out}/findings/batch={n}")

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", state).trigger(availableNow=True).start()


def current_findings(spark: SparkSession, out: str) -> DataFrame:
    """Findings of the last audit of each project."""
    last = spark.read.parquet(f"{out}/audited").groupBy("project_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/findings").join(last, ["project_id", "batch"], "left_semi").drop("batch")
