"""The life of requests and of workers as keyed state: each log row changes the state of one request and one worker, and only changes are put out.

State lies in RocksDB under the checkpoint, so a restart goes on where the last run ended. Rows of a log may come in any order within the watermark's delay.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The process that sets up state beside the driver has not the driver's module path: processors go there with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LOG = "id long, kind string, worker long, at timestamp, seq long"
REQUESTS = "id long, change long, state string, claimed_by long, ended_at timestamp"
WORKERS = "worker long, change long, last_at timestamp, done long, failed long, late boolean"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def folded(events: list[tuple[int, int, str, int]]) -> tuple[str | None, int | None, int | None]:
    """State, claiming worker and end of a request after its events (time, seq, kind, worker): see queue.states."""
    state, claimed_by, ended_at = None, None, None
    for at, _, kind, worker in sorted(events, key=lambda e: e[:2]):
        if state is None and kind == "enqueue":
            state = "pending"
        elif state == "pending" and kind == "claim":
            state, claimed_by = "claimed", worker
        elif state == "claimed" and kind in ("done", "failed") and worker == claimed_by:
            state, ended_at = kind, at
    return state, claimed_by, ended_at


def _ms(us: int, seconds: int) -> int:
    return us // 1000 + 1000 * seconds


class RequestLife(StatefulProcessor):
    """The events of a request until some time after its end; a change of state is a row. What comes later still is not looked at any more."""

    def __init__(self, keep_seconds: int):
        self.keep_seconds = keep_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "us long, seq long, kind string, worker long")
        self.last = handle.getValueState("last", "change long, state string, claimed_by long, ended_us long, closed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        change, *before, closed = tuple(self.last.get()) if self.last.exists() else (0, None, None, None, False)
        new = [(r["us"], r["seq"], r["kind"], r["worker"]) for r in rows if r["kind"] in ("enqueue", "claim", "done", "failed")]
        if closed or not new:
            return
        now = folded([tuple(e) for e in self.events.get()] + new)
        self.events.appendList(new)
        if now != tuple(before):
            self.last.update((change + 1, *now, False))
            if now[2] is not None:
                self.handle.registerTimer(_ms(now[2], self.keep_seconds))
            yield Row(id=key[0], change=change + 1, state=now[0], claimed_by=now[1], ended_us=now[2])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        change, state, claimed_by, ended_us, _ = tuple(self.last.get())
        if ended_us is not None and expiredTimerInfo.getExpiryTimeInMs() >= _ms(ended_us, self.keep_seconds):
            self.events.clear()
            self.last.update((change, state, claimed_by, ended_us, True))
        return iter(())

    def close(self) -> None:
        pass


class WorkerLife(StatefulProcessor):
    """When a worker last reported and what it ended; a timer puts out that it is late, its next report that it is not."""

    def __init__(self, late_seconds: int):
        self.late_seconds = late_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "change long, last_us long, done long, failed long, late boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        change, last_us, done, failed, late = tuple(self.last.get()) if self.last.exists() else (0, None, 0, 0, False)
        reports = [(r["us"], r["kind"]) for r in rows]
        newest = max(at for at, _ in reports)
        if last_us is None or newest > last_us:
            if last_us is not None and not late:
                self.handle.deleteTimer(_ms(last_us, self.late_seconds))
            last_us, late = newest, False
            self.handle.registerTimer(_ms(last_us, self.late_seconds))
        now = (change + 1, last_us, done + sum(k == "done" for _, k in reports), failed + sum(k == "failed" for _, k in reports), late)
        self.last.update(now)
        yield Row(worker=key[0], **dict(zip(("change", "last_us", "done", "failed", "late"), now, strict=True)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        change, last_us, done, failed, late = tuple(self.last.get())
        if not late and expiredTimerInfo.getExpiryTimeInMs() >= _ms(last_us, self.late_seconds):
            self.last.update((change + 1, last_us, done, failed, True))
            yield Row(worker=key[0], change=change + 1, last_us=last_us, done=done, failed=failed, late=True)

    def close(self) -> None:
        pass


def log_stream(spark: SparkSession, path: str, delay: str, max_files: int = 1000) -> DataFrame:
    """The log rows of a folder of Parquet files; those without a time are left out."""
    rows = spark.readStream.schema(LOG).option("maxFilesPerTrigger", max_files).parquet(path)
    return rows.where("at IS NOT NULL").withColumn("us", F.unix_micros("at")).withWatermark("at", delay)


def request_changes(log: DataFrame, keep_seconds: int = 7 * 86_400) -> DataFrame:
    rows = log.where("id IS NOT NULL").groupBy("id").transformWithState(RequestLife(keep_seconds), REQUESTS.replace("ended_at timestamp", "ended_us long"), "append", "eventTime")
    return rows.select("id", "change", "state", "claimed_by", F.timestamp_micros("ended_us").alias("ended_at"))


def worker_changes(log: DataFrame, late_seconds: int) -> DataFrame:
    rows = log.where("worker IS NOT NULL").groupBy("worker").transformWithState(WorkerLife(late_seconds), WORKERS.replace("last_at timestamp", "last_us long"), "append", "eventTime")
    return rows.select("worker", "change", F.timestamp_micros("last_us").alias("last_at"), "done", "failed", "late")


def follow(spark: SparkSession, changes: Callable[[], DataFrame], folder: str, interval: str | None = None, partitions: int | None = None):
    """Write changes to folder/changes, with the state in folder/state; without an interval what is there, and then stop. partitions: of the state, from the first run on; the session's if not given."""
    settings = dict([_PROVIDER]) | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:  # a stream takes the settings of its start
        q = changes().writeStream.format("parquet").outputMode("append").option("path", f"{folder}/changes").option("checkpointLocation", f"{folder}/state")
        return (q.trigger(processingTime=interval) if interval else q.trigger(availableNow=True)).start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


def latest(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The last change of each request or worker."""
    key = schema.split()[0]
    rows = spark.read.schema(schema).parquet(f"{folder}/changes")
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns[1:]), "change").alias("c")).select(key, "c.*")
