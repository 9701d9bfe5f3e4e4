"""Event counts per window on a stream, and the same counts over a finished table."""

from __future__ import annotations

import queue
import threading
import time
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidemill import schemas
from tidemill.plans.runlog import Run, RunLog
from tidemill.sources import tables

# Window length, allowed lateness, trigger period, job name.
WINDOW = "1 minute"
LAG = "30 seconds"
TRIGGER = "15 seconds"
JOB_NAME = "clickstream_sessionization"

KEYS = ["window_start", "window_end", "event_type"]
#: The windows' table has a slot for each day, so a batch rewrites the days it closes windows of.
DAY = "to_date(window_start)"


def kafka_events(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """A topic from its earliest offset; needs Spark's Kafka connector on the class path."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topic).option("startingOffsets", "earliest"))
    return reader.options(**options).load().select("value")


def file_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines from files as they arrive in a folder, oldest first."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select("value")


def decode_events(raw: DataFrame) -> DataFrame:
    """Typed events from JSON payloads (text or bytes); a malformed one fails the query."""
    parsed = F.from_json(F.col("value").cast("string"), schemas.CLICK_EVENT, {"mode": "FAILFAST"})
    return raw.select(parsed.alias("e")).select("e.*").withColumn(
        "event_time", F.col("event_time").cast("timestamp"))


CHECKED = T.StructType([
    *[field for field in schemas.CLICK_EVENT.fields if field.name != "event_time"],
    T.StructField("event_time", T.TimestampType()), T.StructField("record", T.StringType()),
    T.StructField("reason", T.StringType()),
])


def decode_checked(raw: DataFrame) -> DataFrame:
    """Typed events from JSON payloads with ``reason`` (null: good) and the ``record`` as it came.

    Rejected are payloads that aren't JSON objects, hold a value of another type, or have no valid event time.
    """
    text = F.col("value").cast("string")
    kinds = T.StructType([*schemas.CLICK_EVENT.fields, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(text, kinds, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = raw.select(text.alias("record"), parsed.alias("e"))
    at = F.col("e.event_time").try_cast("timestamp")
    # The parser stops behind the first value; as one of two in a list a payload with more behind it shows.
    alone = F.json_array_length(F.concat(F.lit("["), F.col("record"), F.lit(",0]"))) == 2
    broken = F.col("e").isNull() | F.col("e._corrupt").isNotNull() | ~F.coalesce(alone, F.lit(False))
    reason = (F.when(broken, "not a JSON event")
              .when(F.col("e.event_time").isNull(), "event_time is missing")
              .when(at.isNull(), "event_time is no timestamp"))
    plain = [F.col(f"e.{f.name}") for f in schemas.CLICK_EVENT.fields if f.name != "event_time"]
    return rows.select(*plain, at.alias("event_time"), "record", reason.alias("reason"))


def part_events(raw: DataFrame, folder: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Start parting a stream of payloads into good and rejected events, both below ``folder``.

    Every batch is parsed once and written once, in two parts; a batch that is repeated replaces its own.
    """
    def part(batch: DataFrame, batch_id: int) -> None:
        (decode_checked(batch).withColumn("batch", F.lit(batch_id)).withColumn("rejected", F.col("reason").isNotNull())
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch", "rejected").parquet(folder))

    writer = raw.writeStream.foreachBatch(part).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)).start()


_PARTED = T.StructType([*CHECKED.fields, T.StructField("batch", T.LongType()), T.StructField("rejected", T.BooleanType())])


def good_events(spark: SparkSession, folder: str) -> DataFrame:
    """The good events of a parted stream, as a stream of their own."""
    return (spark.readStream.schema(_PARTED).parquet(folder).filter("not rejected")
            .drop("record", "reason", "batch", "rejected"))


def rejected_events(spark: SparkSession, folder: str) -> DataFrame:
    """The payloads a parted stream rejected so far, with the reason."""
    return spark.read.schema(_PARTED).parquet(folder).filter("rejected").select("batch", "record", "reason")


def window_counts(events: DataFrame, window: str = WINDOW, lag: str = LAG) -> DataFrame:
    """Events and distinct sessions per tumbling window and event type of a stream.

    Distinct sessions are counted in two levels: state holds one small row per
    (window, type, session), so no set grows inside a group, and a busy
    window's rows are spread by session. A window is emitted once, when the
    watermark passes its end; rows later than that are dropped.
    """
    return _two_levels(events.withWatermark("event_time", lag), window)


def window_counts_batch(events: DataFrame, window: str = WINDOW) -> DataFrame:
    """The same counts over a whole table, with every window closed."""
    return _two_levels(events, window)


def _two_levels(events: DataFrame, window: str) -> DataFrame:
    per_session = (events.groupBy(F.window("event_time", window).alias("w"),
                                  "event_type", "session_id")
                   .agg(F.count(F.lit(1)).alias("n")))
    if events.isStreaming:
        again = F.window(F.window_time("w"), window).alias("w")  # carries the event time on
        grouped = per_session.groupBy(again, "event_type")
    else:
        grouped = per_session.groupBy("w", "event_type")
    return (grouped.agg(F.sum("n").alias("event_count"),
                        F.count(F.lit(1)).alias("distinct_sessions"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "event_type", "event_count", "distinct_sessions"))


@dataclass
class StreamTotals:
    batches: int = 0
    rows_read: int = 0
    windows_closed: int = 0
    rows_too_late: int = 0
    windows_flushed: int = 0


class Heartbeats(StreamingQueryListener):
    """Logs a run for every micro-batch of one query, from the progress Spark reports as it comes.

    A run's id follows from the query's and the batch's, so a batch that is repeated after a
    restart adds no run. Spark's thread only queues the report; another appends to the log.
    """

    def __init__(self, name: str, closed: dict[int, int], run_log: RunLog, input_name: str, path: str,
                 job_name: str) -> None:
        self.name, self.closed, self.totals = name, closed, StreamTotals()
        self.run_log, self.input_name, self.path, self.job_name = run_log, input_name, path, job_name
        self.reported, self.ended = 0, threading.Event()
        self.run_id: str | None = None
        self.waiting: queue.SimpleQueue = queue.SimpleQueue()
        self.writer = threading.Thread(target=self._write, daemon=True)
        self.failure: Exception | None = None
        self.writer.start()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.run_id = str(event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        if event.progress.name == self.name:
            self.reported += 1
            if event.progress.batchId in self.closed:  # a trigger without data repeats the last number
                self.waiting.put((event.progress, self.closed.pop(event.progress.batchId)))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) == self.run_id:
            self.ended.set()

    def _write(self) -> None:
        while (item := self.waiting.get()) is not None:
            items = [item]
            while not self.waiting.empty() and items[-1] is not None:
                items.append(self.waiting.get())
            try:
                self.run_log.end_all([self._run(*one) for one in items if one is not None])
            except Exception as error:  # raised where the stream is waited for
                self.failure = error
            if items[-1] is None:
                return

    def _run(self, progress, written: int) -> tuple[Run, datetime]:
        started = datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00"))
        took = progress.durationMs.get("triggerExecution", 0)
        run = Run(str(uuid.uuid5(progress.id, str(progress.batchId))), self.job_name, "streaming", started,
                  [self.input_name], rows_read=progress.numInputRows, rows_written=written, output_tables=[self.path])
        self.totals.batches += 1
        self.totals.rows_read += progress.numInputRows
        self.totals.windows_closed += written
        self.totals.rows_too_late += sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        return run, started + timedelta(milliseconds=took)

    def close(self, patience: float = 60.0) -> None:
        """Wait for the last report, which Spark delivers after the query's end, and for the log."""
        if self.run_id:
            self.ended.wait(patience)
        self.waiting.put(None)
        self.writer.join(patience)
        if self.failure:
            raise self.failure


class Brake:
    """Ends a stream between two batches: the one under way is finished, the next fails before it has begun."""

    def __init__(self) -> None:
        self.merging, self.left = False, -1  # batches that may still run; negative: any

    def press(self, query: StreamingQuery) -> None:
        """Let what a trigger has taken up end, and nothing more; returns when it has."""
        self.left = 1 if query.status["isTriggerActive"] and not self.merging else 0
        while query.isActive and query.status["isTriggerActive"]:
            time.sleep(0.05)
        self.left = 0

    def begin(self, batch_id: int) -> None:
        if self.left == 0:
            raise RuntimeError(f"stopped before batch {batch_id}")
        self.left -= self.left > 0
        self.merging = True


def start_stream(windows: DataFrame, path: str, checkpoint: str, trigger: str | None = TRIGGER,
                 closed: dict[int, int] | None = None, name: str | None = None,
                 brake: Brake | None = None) -> StreamingQuery:
    """Start merging closed windows into the table at ``path``.

    The merge is keyed by window, so a batch repeated after a failure changes
    nothing. Open windows live in the checkpoint and are picked up on restart.
    ``trigger`` None processes what is there and stops.
    """
    brake = brake or Brake()

    def merge(batch: DataFrame, batch_id: int) -> None:
        brake.begin(batch_id)
        seen = Observation()
        # The merge stages its source first, so the stateful plan runs once, and is counted there.
        tables.upsert(batch.sparkSession, path, batch.observe(seen, F.count(F.lit(1)).alias("n")), KEYS, DAY)
        if closed is not None:
            closed[batch_id] = seen.get["n"]
        brake.merging = False

    writer = (windows.writeStream.outputMode("append").foreachBatch(merge)
              .option("checkpointLocation", checkpoint))
    if name:
        writer = writer.queryName(name)
    writer = (writer.trigger(availableNow=True) if trigger is None
              else writer.trigger(processingTime=trigger))
    return writer.start()


def run_stream(windows: DataFrame, path: str, checkpoint: str, run_log: RunLog,
               input_name: str, trigger: str | None = TRIGGER, timeout: float | None = None,
               idle: float | None = None, job_name: str = JOB_NAME, flush: bool = False,
               poll: float = 0.5) -> StreamTotals:
    """Run a stream, with a heartbeat run per micro-batch.

    Without a trigger period it ends when all there is has been read. With one it ends after
    ``timeout`` seconds, or when no data came for ``idle`` seconds, between two
    batches: what the batch under way reads is finished, and a later run goes on from the checkpoint.
    With ``flush`` the windows still open are then merged too, as a run of their own.
    """
    spark = windows.sparkSession
    closed: dict[int, int] = {}
    beats = Heartbeats(f"{job_name}-{uuid.uuid4().hex}", closed, run_log, input_name, path, job_name)
    spark.streams.addListener(beats)
    begun = datetime.now(timezone.utc)
    try:
        brake = Brake()
        query = start_stream(windows, path, checkpoint, trigger, closed, beats.name, brake)
        try:
            _wait(query, beats, timeout, idle, poll)
            brake.press(query)
        finally:
            query.stop()
        beats.close()
    except Exception as error:
        beats.waiting.put(None)
        run_log.fail(job_name, str(error), Run(str(uuid.uuid4()), job_name, "streaming", begun, [input_name]))
        raise
    finally:
        spark.streams.removeListener(beats)
    if flush:
        beats.totals.windows_flushed = flush_open(spark, path, checkpoint, run_log, input_name, job_name)
    return beats.totals


def _wait(query: StreamingQuery, beats: Heartbeats, timeout: float | None, idle: float | None, poll: float) -> None:
    deadline = None if timeout is None else time.monotonic() + timeout
    quiet = None  # since when there is nothing to read
    while not query.awaitTermination(poll):
        now, status = time.monotonic(), query.status
        if status["isTriggerActive"] or status["isDataAvailable"] or not beats.reported:
            quiet = None
        elif quiet is None:
            quiet = now
        if deadline is not None and now >= deadline:
            return
        if idle is not None and quiet is not None and now - quiet >= idle:
            return


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The counts so far of the windows a stopped stream has still open, read from its state.

    A window's sessions are in the state of the first level until it closes, and its sums in that of
    the second until they are given out; no session is in both.
    """
    operators = spark.read.format("state-metadata").load(checkpoint).select("operatorId").distinct().collect()
    parts = []
    for row in operators:  # two
        state = spark.read.format("statestore").option("operatorId", row[0]).load(checkpoint)
        if "session_id" in state.schema["key"].dataType.fieldNames():
            counts = F.col("value.count"), F.lit(1).cast("long")
        else:
            counts = F.col("value.sum"), F.col("value.count")
        parts.append(state.select(
            F.col("key.window.start").alias("window_start"), F.col("key.window.end").alias("window_end"),
            F.col("key.event_type").alias("event_type"), counts[0].alias("events"), counts[1].alias("sessions")))
    return (reduce(DataFrame.unionByName, parts).groupBy(*KEYS)
            .agg(F.sum("events").alias("event_count"), F.sum("sessions").alias("distinct_sessions")))


def flush_open(spark: SparkSession, path: str, checkpoint: str, run_log: RunLog, input_name: str,
               job_name: str = JOB_NAME) -> int:
    """Merge the windows a stopped stream has still open, as one run; returns how many.

    The state stays as it is: when the stream goes on and such a window closes, its
    final row replaces this one.
    """
    with run_log.track(job_name, "streaming", [input_name]) as run:
        seen = Observation()
        left = open_windows(spark, checkpoint).observe(seen, F.count(F.lit(1)).alias("n"))
        tables.upsert(spark, path, left, KEYS, DAY)
        run.rows_written, run.output_tables = seen.get["n"], [path]
    return run.rows_written
