from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from dossier.plans import screening
from dossier.streaming import activity as A
from dossier.streaming import jobs as J

START = datetime(2024, 1, 1)


@pytest.fixture
def items(spark, tmp_path):
    """Item events in several files, read as a stream or as a table."""
    rows = [(f"job{i % 4}", f"item{i % 25}", ["completed", "error", "pending", "completed"][i % 4 if i % 5 else 0],
             START + timedelta(seconds=20 * i), i % 3) for i in range(120)]
    schema = "job_id STRING, item STRING, status STRING, ts TIMESTAMP, user_id INT"
    path = str(tmp_path / "items")
    for k in range(3):  # in time order, one file per append
        spark.createDataFrame(rows[40 * k:40 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return spark.read.schema(schema).parquet(path), stream


def run(df, mode, tmp_path):
    """Run a stream to its end and return what each micro-batch put out."""
    batches = []
    query = (df.writeStream.outputMode(mode).trigger(availableNow=True)
             .option("checkpointLocation", str(tmp_path / "checkpoint"))
             .foreachBatch(lambda batch, _: batches.append(batch.collect())).start())
    query.awaitTermination()
    return batches


def test_progress_stream_equals_table(items, tmp_path):
    table, stream = items
    last = {}
    for batch in run(A.batch_progress(stream), "update", tmp_path):
        last.update({r.job_id: r for r in batch})
    assert last == {r.job_id: r for r in A.batch_progress(table).collect()}


def test_quota_stream_equals_table(items, tmp_path):
    table, stream = items
    last = {}
    for batch in run(A.quota_usage(stream, 1), "update", tmp_path):
        last.update({(r.client, r.minute): r for r in batch})
    assert last == {(r.client, r.minute): r for r in A.quota_usage(table, 1).collect()}


def test_route_statistics_on_a_stream(items, tmp_path):
    table, stream = items
    last = {}
    for batch in run(A.route_statistics(stream, "status", "user_id"), "update", tmp_path):
        last.update({(r.route, r.start): r.requests for r in batch})
    assert last == {(r.route, r.start): r.requests
                    for r in A.route_statistics(table, "status", "user_id").collect()}


def test_first_per_key(items, tmp_path):
    table, stream = items
    seen = [r.item for batch in run(A.first_per_key(stream, "item"), "append", tmp_path) for r in batch]
    assert sorted(seen) == sorted(r.item for r in A.first_per_key(table, "item").collect())
    assert len(seen) == len(set(seen)) == 25


def test_expired_jobs_leave(spark):
    jobs = spark.createDataFrame([("a", "completed", START), ("b", "processing", START),
                                  ("c", "completed", START + timedelta(minutes=45))],
                                 "job_id STRING, status STRING, created_at TIMESTAMP")
    left = A.live_jobs(jobs, F.lit(START + timedelta(minutes=60)))
    assert sorted(r.job_id for r in left.collect()) == ["b", "c"]


def minute(m):
    return START + timedelta(minutes=m)


def logged(spark, tmp_path, parts):
    """The log as a table, and its progress rows and query as a stream of one file a part."""
    path = str(tmp_path / "log")
    for rows in parts:
        spark.createDataFrame(rows, J.LOG).coalesce(1).write.mode("append").parquet(path)
    own = J.state_session(spark)
    stream = own.readStream.schema(J.LOG).option("maxFilesPerTrigger", 1).parquet(path)
    query = J.run_to_end(J.tracked_jobs(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.schema(J.LOG).parquet(path), spark.read.parquet(str(tmp_path / "out")), query


def announced(job, total, m):
    return (job, "announced", total, None, minute(m), minute(m))


def item(job, m, status="completed", wait=1):
    return (job, "item", None, status, minute(m), minute(m + wait))


def test_tracked_jobs(spark, tmp_path):
    table, rows, query = logged(spark, tmp_path, [
        [announced("done", 2, 0), item("done", 1), item("done", 2, "error"), announced("open", 3, 0),
         item("open", 3), item("none", 3), announced("empty", 0, 1)],
        [item("open", 40), announced("late", 2, 41), item("late", 42), item("late", 42, wait=15)],
        [item("open", 100, wait=30), announced("fresh", 1, 125), item("fresh", 129)]])
    last = {r.job_id: tuple(r)[1:] for r in J.latest(rows).collect()}
    # completed, errors, late, total, progress, status
    assert last == {
        "done": (2, 1, 0, 2, 100, "expired"), "open": (2, 0, 1, 3, 67, "processing"),
        "none": (1, 0, 0, 0, 0, "unannounced"), "empty": (0, 0, 0, 0, 0, "expired"),
        "late": (1, 0, 1, 2, 50, "processing"), "fresh": (1, 0, 0, 1, 100, "completed")}
    assert {r.job_id: tuple(r)[1:] for r in J.job_table(table).collect()} == last
    # a running job never leaves, and only what has not left is kept
    assert not rows.filter("job_id in ('open', 'late') and status = 'expired'").count()
    kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert kept <= 3 * 2 + 1       # a state row each, and the timers of completed jobs


def test_state_holds_running_jobs_only(spark, tmp_path):
    parts = [[row for k in range(20) for row in (announced(f"{part}-{k}", 1, 60 * part + k),
                                                 item(f"{part}-{k}", 60 * part + k))] for part in range(4)]
    table, rows, query = logged(spark, tmp_path, parts)
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) <= 2 * 40 + 3 and sizes[-1] < 80       # of 80 jobs with a timer each
    assert rows.filter("status = 'expired'").select("job_id").distinct().count() >= 60
    assert J.latest(rows).count() == 80 == J.job_table(table).count()


def test_merged_sketches_on_a_stream(items, tmp_path):
    table, stream = items
    out = [r for batch in run(A.route_sketches(stream, "status", "user_id"), "append", tmp_path) for r in batch]
    assert all(r.requests > 0 and r.sketch for r in out)
    merged = {r.route: r for r in A.merge_routes(A.route_sketches(table, "status", "user_id", "1 minute"), "route").collect()}
    for route, r in merged.items():
        values = sorted(x.user_id for x in table.filter(F.col("status") == route).collect())
        assert r.requests == len(values) and r.max_duration == values[-1]
        assert r.mean_duration == pytest.approx(sum(values) / len(values))
        assert values[int(0.94 * (len(values) - 1))] <= r.p95_duration <= values[-1]


def test_screening_stream_equals_table(spark, tmp_path):
    schema = "doc_id LONG, job_id LONG, text STRING"
    texts = [(i, 1, f"Email: u{i}@example.org 555-010-{1000 + i} skills experience education python") for i in range(6)]
    jobs = spark.createDataFrame([(1, "", "python developer")], "job_id LONG, title STRING, description STRING")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame(texts[3 * k:3 * k + 3], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    model = screening.encoder(spark.read.schema(schema).parquet(path))
    screening.screen_stream(stream, jobs, out, str(tmp_path / "checkpoint"), "ann", model=model).awaitTermination()
    with pytest.raises(ValueError):
        screening.screen_stream(stream, jobs, out, str(tmp_path / "other"), "ann")
    assert {r.username for r in spark.read.parquet(out).collect()} == {"ann"}
    got = {r.id: r.classification for r in spark.read.parquet(out).collect()}
    want = screening.screen(spark.read.schema(schema).parquet(path), jobs)
    assert got == {r.doc_id: r.classification for r in want.collect()} and len(got) == 6


def test_tracker_takes_rows_and_one_look_at_the_state():
    """A job's few rows are met one by one, and its state is fetched once."""
    calls, kept = [], {}

    class Held:
        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "getValueState":
                    return self
                if name == "update":
                    kept["state"] = args[0]
                return kept.get("state") if name == "get" else None
            return call

        def getCurrentWatermarkInMs(self):
            return 0

    tracker = J.JobTracker(30)
    tracker.init(Held())
    row = lambda kind, at, total=None, status=None, tardy=False: Row(
        kind=kind, total=total, status=status, at=at, tardy=tardy)
    first = list(tracker.handleInputRows(("a",), iter([row("item", 5, status="error"), row("announced", 2, 3)]), Held()))
    assert [r.asDict() for r in first] == [dict(
        job_id="a", completed=1, errors=1, late=0, total=3, progress=33, status="processing")]
    calls.clear()
    done = list(tracker.handleInputRows(("a",), iter([
        row("item", 6, status="completed"), row("item", 7, status="completed"), row("item", 1, status="error", tardy=True)]), Held()))
    assert (done[0].completed, done[0].late, done[0].status) == (3, 1, "completed")
    assert calls == ["get", "registerTimer", "update"] and kept["state"][-1] == 2 + 30 * 60_000
