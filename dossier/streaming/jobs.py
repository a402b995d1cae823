"""Announced jobs over a stream: progress, late items, and expiry of completed jobs.

A log row either announces a job with its number of items or reports one finished item:
(job_id, kind 'announced' or 'item', total, status, ts, seen_at), ``seen_at`` being the time of
arrival.  Announcements and items arrive in one stream, in any order.

The clock is the arrival time less ``DISORDER_SECONDS``, by which arrivals may come out of order; so
no row is dropped for its own age: an item that arrives more than ``lateness`` after its own
time is counted as late, apart from the completed ones.  A
completed job leaves ``ttl`` minutes after its announced creation; a running one never does.  Items
without an announcement leave after the same time, counted from the first of them, so the state
holds running jobs and those of the last ``ttl`` minutes only.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from dossier.streaming.activity import TTL_MINUTES

LATENESS_MINUTES, DISORDER_SECONDS = 10, 60
LOG = ("job_id string, kind string, total long, status string, ts timestamp, seen_at timestamp")
PROGRESS = ("job_id string, completed long, errors long, late long, total long, progress long, "
            "status string")
_STATE = "created long, total long, completed long, errors long, late long, timer long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def percent_done(completed: int, total: int) -> int:
    """Rounded half up; 0 for an empty job."""
    return (200 * completed + total) // (2 * total) if total > 0 else 0


class JobTracker(StatefulProcessor):
    """One state row per job; its timer stands once the job is completed or unannounced."""

    def __init__(self, ttl: int):
        self.ttl = ttl * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues):
        held = self.state.get()
        created, total, completed, errors, late, timer = held or (None, None, 0, 0, 0, None)
        first = None
        for row in rows:        # one after the other: a hot job is never held whole
            if row.kind == "announced":
                created = row.at if created is None else min(created, row.at)
                if row.total is not None:
                    total = row.total if total is None else max(total, row.total)
            elif row.kind == "item":
                first = row.at if first is None else min(first, row.at)
                late += row.tardy
                completed += not row.tardy and row.status in ("completed", "error")
                errors += not row.tardy and row.status == "error"
        if total is None:
            wanted = timer if timer is not None else first + self.ttl
        else:
            wanted = created + self.ttl if completed >= total else None
        if wanted != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wanted is not None:
                # a moment that has passed is met at the next batch
                wanted = max(wanted, timerValues.getCurrentWatermarkInMs() + 1)
                self.handle.registerTimer(wanted)
            timer = wanted
        self.state.update((created, total, completed, errors, late, timer))
        yield self._row(key, total, completed, errors, late, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        created, total, completed, errors, late, timer = self.state.get()
        self.state.clear()
        yield self._row(key, total, completed, errors, late,
                        "unannounced" if total is None else "expired")

    def _row(self, key, total, completed, errors, late, status):
        known = total or 0
        if status is None:
            status = "completed" if total is not None and completed >= known else "processing"
        return Row(job_id=key[0], completed=completed, errors=errors, late=late, total=known,
                   progress=percent_done(completed, known), status=status)

    def close(self) -> None:
        pass


def tracked_jobs(log: DataFrame, ttl: int = TTL_MINUTES, lateness: int = LATENESS_MINUTES
                 ) -> DataFrame:
    """Stream of progress rows: one per job and batch that touches it, and a last one when it
    leaves ('expired' or 'unannounced').  Needs the RocksDB state store (``PROVIDER``).

    A job has a few rows in a batch, so they reach the tracker as rows, with the moment in
    milliseconds and the lateness found before: a frame for every job costs more than its rows.
    """
    tardy = F.col("seen_at") - F.col("ts") > F.expr(f"INTERVAL '{lateness}' MINUTE")
    return log.withWatermark("seen_at", f"{DISORDER_SECONDS} seconds").select(
        "job_id", "kind", "total", "status", F.unix_millis("ts").alias("at"),
        F.coalesce(tardy, F.lit(False)).alias("tardy"), "seen_at").groupBy("job_id").transformWithState(
        JobTracker(ttl), PROGRESS, "Update", "EventTime")


def job_table(log: DataFrame, ttl: int = TTL_MINUTES, lateness: int = LATENESS_MINUTES
              ) -> DataFrame:
    """The same progress from a whole log, as of its last arrival; items that arrive after
    their job has left would begin a new one in the stream."""
    item = F.col("kind") == "item"
    tardy = F.col("seen_at") - F.col("ts") > F.expr(f"INTERVAL '{lateness}' MINUTE")
    done = item & ~tardy & F.col("status").isin("completed", "error")
    jobs = log.groupBy("job_id").agg(
        F.count_if(done).alias("completed"),
        F.count_if(done & (F.col("status") == "error")).alias("errors"),
        F.count_if(item & tardy).alias("late"),
        F.max(F.when(~item, F.col("total"))).alias("announced"),
        F.min(F.when(~item, F.col("ts"))).alias("created"),
        F.min(F.when(item, F.col("ts"))).alias("first"))
    now = log.agg((F.max("seen_at") - F.expr(f"INTERVAL '{DISORDER_SECONDS}' SECOND")).alias("now"))
    total = F.coalesce("announced", F.lit(0))
    over = F.coalesce("created", "first") + F.expr(f"INTERVAL '{ttl}' MINUTE") <= F.col("now")
    full = F.col("announced").isNotNull() & (F.col("completed") >= total)
    return jobs.join(F.broadcast(now), F.lit(True)).select(     # one row
        "job_id", "completed", "errors", "late", total.alias("total"),
        F.coalesce(F.expr("(200 * completed + announced) div nullif(2 * announced, 0)"),
                   F.lit(0)).cast("long").alias("progress"),
        F.when(full & over, "expired").when(full, "completed")
        .when(F.col("announced").isNull() & over, "unannounced").otherwise("processing").alias("status"))


def state_session(spark: SparkSession) -> SparkSession:
    """A session of the same application that keeps stream state as the tracker needs it."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", str(min(
        int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)))
    return own


def run_to_end(progress: DataFrame, out: str, checkpoint: str):
    """Run a progress stream over all that has arrived and append its rows to ``out``; a batch
    that is retried writes to the same folder again."""
    def append(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (progress.writeStream.outputMode("update").foreachBatch(append)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def latest(rows: DataFrame) -> DataFrame:
    """The last progress row of every job of a folder written by ``run_to_end``."""
    columns = [c for c in rows.columns if c not in ("job_id", "batch")]
    return rows.groupBy("job_id").agg(F.max_by(F.struct(*columns), F.struct(
        "batch", F.col("status").isin("expired", "unannounced"))).alias("r")).select("job_id", "r.*")
