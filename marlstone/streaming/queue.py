"""The index queue as a stream: requests arrive as files, each micro-batch is worked off by priority.

Order holds within a micro-batch. Processing is idempotent: what is in the index already is skipped, so a batch that is run again after a
failure gives the same index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import row_numbers
from ..operators.filings import coverage, form_of_status, priority
from ..sources.merge import last_write_wins, newer_wins

REQUEST = "id string, ticker string, form string, requested_at timestamp, accession string, priority int, force boolean"


def requests(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The stream of request files; text that is no request has only _corrupt_record."""
    return spark.readStream.schema(REQUEST + ", _corrupt_record string").option("maxFilesPerTrigger", max_files).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def sound(batch: DataFrame) -> DataFrame:
    """Requests that can be worked off, with their priority: that of the form where none is given."""
    return batch.where("id IS NOT NULL AND ticker IS NOT NULL").withColumn("priority", F.coalesce("priority", priority(F.col("form"))))


def pending(batch: DataFrame) -> DataFrame:
    """Sound requests with their place: by priority, then arrival, then id."""
    p = sound(batch)
    # Priorities are a few whole numbers: with the time as a fraction they make one number to cut at.
    when = F.coalesce(F.unix_micros(F.col("requested_at").cast("timestamp")), F.lit(0)) / 1e17
    return row_numbers(p, "place", F.coalesce("priority", F.lit(-1)) + F.greatest(F.lit(0.0), F.least(F.lit(0.999), when)), [F.col("priority"), F.col("requested_at"), F.col("id")])


def outcome(batch: DataFrame, index: DataFrame, commit: str | None) -> DataFrame:
    """What becomes of each sound request: skipped (indexed and current, not forced) or indexed; of equal requests only the first is done."""
    i = index.select(F.col("ticker").alias("_t"), form_of_status(F.col("form")).alias("_f"), F.col("commit").alias("_c"))
    key = form_of_status(F.col("form"))
    j = batch.withColumn("_key", key).join(i, (F.col("ticker") == F.col("_t")) & (F.col("_key") == F.col("_f")), "left")
    current = F.col("_f").isNotNull() & (F.lit(commit).isNull() | F.col("_c").eqNullSafe(F.lit(commit)))
    w = Window.partitionBy("ticker", "_key").orderBy("priority", "requested_at", "id")
    j = j.withColumn("_k", F.row_number().over(w))
    done = F.when(current & ~F.coalesce("force", F.lit(False)), "skipped").when(F.col("_k") > 1, "skipped").otherwise("indexed")
    return j.withColumn("state", done).drop("_t", "_f", "_c", "_k", "_key")


def upsert_status(status: DataFrame, done: DataFrame) -> DataFrame:
    """Status rows by (ticker, accession): the newest replaces."""
    return newer_wins(status, last_write_wins(done, ["ticker", "accession"], ["place"]).select(status.columns), ["ticker", "accession"])


def run(spark: SparkSession, path: str, checkpoint: str, work: Callable[[DataFrame, int], None], interval: str | None = None):
    """Work off the queue; without an interval what is there, and then stop."""
    q = requests(spark, path).writeStream.foreachBatch(lambda df, n: work(pending(df), n)).option("checkpointLocation", checkpoint)
    return (q.trigger(processingTime=interval) if interval else q.trigger(availableNow=True)).start()


def requeue(index: DataFrame, at) -> DataFrame:
    """Requests to index everything anew."""
    return index.select(F.concat_ws("-", F.lit("again"), "ticker", "accession").alias("id"), "ticker", "form", F.lit(at).cast("timestamp").alias("requested_at"), "accession", priority(F.col("form")).alias("priority"), F.lit(True).alias("force"))


def report(status: DataFrame) -> DataFrame:
    """Per ticker: filings, the last state, readiness and gaps."""
    last = status.groupBy(F.upper("ticker").alias("ticker")).agg(F.max_by("state", F.struct("requested_at", "accession")).alias("last_state"))
    return coverage(status).join(last, "ticker")


def states(log: DataFrame) -> DataFrame:
    """Per request of a log (id, kind, worker, at, seq): state pending, claimed, done or failed, with who claimed it and when it ended.

    A request exists from its first enqueue. The first claim after that holds, whoever else claims it too; only what the claiming worker
    reports after its claim ends it, and the first such report counts. A log is small rows and any order of them gives the same, so it can be read as a stream's table.
    """
    when = F.struct("at", "seq")
    put = log.where("kind = 'enqueue'").groupBy("id").agg(F.min(when).alias("put"))
    later = log.join(put, "id").where(when > F.col("put"))
    claim = later.where("kind = 'claim'").groupBy("id").agg(F.min(F.struct("at", "seq", "worker")).alias("c")).select("id", F.col("c.worker").alias("claimed_by"), F.struct("c.at", "c.seq").alias("claimed"))
    ended = later.where("kind IN ('done', 'failed')").join(claim, "id").where((F.col("worker") == F.col("claimed_by")) & (when > F.col("claimed")))
    ended = ended.groupBy("id").agg(F.min(F.struct("at", "seq", "kind")).alias("e")).select("id", F.col("e.kind").alias("ended"), F.col("e.at").alias("ended_at"))
    j = put.join(claim, "id", "left").join(ended, "id", "left")
    return j.select("id", F.coalesce("ended", F.when(F.col("claimed_by").isNotNull(), "claimed"), F.lit("pending")).alias("state"), "claimed_by", "ended_at")


def health(log: DataFrame, versions: DataFrame, current: str, now: Column, late_seconds: int) -> DataFrame:
    """Per worker: when it last reported, whether that is too long ago, and whether it runs the current code. versions: worker, commit."""
    seen = log.groupBy("worker").agg(F.max("at").alias("last_at"), F.count_if(F.col("kind") == "done").alias("done"), F.count_if(F.col("kind") == "failed").alias("failed"))
    late = F.unix_timestamp(now) - F.unix_timestamp("last_at") > late_seconds
    return versions.join(seen, "worker", "left").select("worker", "last_at", F.coalesce("done", F.lit(0)).alias("done"), F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce(late, F.lit(True)).alias("late"), (~F.col("commit").eqNullSafe(F.lit(current))).alias("outdated"))
