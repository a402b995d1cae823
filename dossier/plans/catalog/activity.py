"""Progress, quotas, request statistics and expiry (table form of the streams)."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.plans import inputs as I
from dossier.plans.catalog import query
from dossier.session import scratch_path, write_once
from dossier.streaming import activity as A
from dossier.streaming import jobs as J

_JOB = "concat(user_id, '-', strftime(ts, '%Y-%m-%d'))"
_STATUS = ("case event_type when 'error' then 'error' when 'signup' then 'pending' else 'completed' end")


def items(spark, d):
    return I.table(spark, d, "events").select(
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("job_id"),
        F.col("event_id").cast("string").alias("item"), F.expr(_STATUS).alias("status"), "ts")


PROGRESS_SQL = f"""WITH i AS (SELECT {_JOB} AS job_id, {_STATUS} AS status, ts FROM events),
g AS (SELECT job_id, count(CASE WHEN status <> 'pending' THEN 1 END) AS completed, count(CASE WHEN status = 'error' THEN 1 END) AS errors, count(*) AS total, min(ts) AS created_at FROM i GROUP BY job_id),
p AS (SELECT *, CAST(round(completed * 100.0 / total) AS BIGINT) AS progress, CASE WHEN completed >= total THEN 'completed' ELSE 'processing' END AS status FROM g)"""


@query("k1_a12_batch_progress", f"{PROGRESS_SQL} SELECT job_id, completed, errors, total, progress, status FROM p")
def progress(spark, d):
    return A.batch_progress(items(spark, d))


@query("k2_live_jobs", f"""{PROGRESS_SQL} SELECT job_id, status FROM p WHERE NOT (status = 'completed'
 AND epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', created_at)) > 1800)""")
def live(spark, d):
    rows = items(spark, d)
    jobs = A.batch_progress(rows).join(rows.groupBy("job_id").agg(F.min("ts").alias("created_at")), "job_id")
    now = rows.agg(F.max("ts")).scalar()
    stamped = jobs.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return A.live_jobs(stamped, now.cast("timestamp")).select("job_id", "status")


@query("k3_quota_usage", """SELECT user_id AS client, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS requests, CAST(count(*) > 1 AS INT) AS over_quota
FROM events GROUP BY 1, 2""")
def quota(spark, d):
    return A.quota_usage(I.table(spark, d, "events"), 1).select(
        "client", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "requests",
        F.col("over_quota").cast("int").alias("over_quota"))


@query("k4_route_statistics", """SELECT event_type AS route, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, count(*) AS requests,
 round(avg(value), 6) AS mean_duration, max(value) AS max_duration FROM events GROUP BY 1, 2""")
def routes(spark, d):
    return A.route_statistics(I.table(spark, d, "events")).select(
        "route", F.date_format("start", "yyyy-MM-dd HH").alias("start"), "requests",
        F.round("mean_duration", 6).alias("mean_duration"), "max_duration")


@query("k7_first_per_key", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def firsts(spark, d):
    # the first event of a user in time is also the one with the lowest id
    return A.first_per_key(I.table(spark, d, "events").select("ts", "user_id", "event_id"), "user_id").select(
        "user_id", "event_id")


# a day of a user is a job: it is announced when it begins, with one item too many for every third
# user; every item arrives a minute after its time, every eleventh 25 minutes
_LOG_SQL = f"""WITH e AS (SELECT {_JOB} AS job_id, user_id, event_id, ts, {_STATUS.replace("'pending'", "'completed'")} AS status,
  ts + CASE WHEN event_id % 11 = 0 THEN INTERVAL 25 MINUTE ELSE INTERVAL 1 MINUTE END AS seen_at FROM events),
j AS (SELECT job_id, count(*) + CASE WHEN any_value(user_id) % 3 = 0 THEN 1 ELSE 0 END AS total, min(ts) AS created,
  count(CASE WHEN event_id % 11 <> 0 THEN 1 END) AS completed, count(CASE WHEN event_id % 11 <> 0 AND status = 'error' THEN 1 END) AS errors,
  count(CASE WHEN event_id % 11 = 0 THEN 1 END) AS late FROM e GROUP BY job_id),
t AS (SELECT *, (SELECT max(seen_at) FROM e) - INTERVAL 60 SECOND AS now FROM j)
SELECT job_id, completed, errors, late, total, CAST(floor(completed * 100e0 / total + 5e-1) AS BIGINT) AS progress,
 CASE WHEN completed < total THEN 'processing' WHEN created + INTERVAL 30 MINUTE <= now THEN 'expired' ELSE 'completed' END AS status FROM t"""


def job_log(spark, d):
    e = I.table(spark, d, "events").select(
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("job_id"), "user_id",
        F.when(F.col("event_type") == "error", "error").otherwise("completed").alias("status"),
        F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 11 == 0, 25).otherwise(1).alias("wait"))
    finished = e.select("job_id", F.lit("item").alias("kind"), F.lit(None).cast("long").alias("total"), "status", "ts",
                        (F.col("ts") + F.make_dt_interval(mins=F.col("wait"))).alias("seen_at"))
    announced = e.groupBy("job_id", "user_id").agg(F.min("ts").alias("ts"), F.count("*").alias("n")).select(
        "job_id", F.lit("announced").alias("kind"),
        (F.col("n") + F.when(F.col("user_id") % 3 == 0, 1).otherwise(0)).alias("total"),
        F.lit(None).cast("string").alias("status"), "ts",
        (F.col("ts") + F.expr("INTERVAL 30 SECONDS")).alias("seen_at"))
    return finished.unionByName(announced)


@query("k1_k2_announced_jobs", _LOG_SQL)
def announced(spark, d):
    return J.job_table(job_log(spark, d))


ROWS_PER_FILE = 25_000


@query("k1_k2_tracked_stream", _LOG_SQL)
def tracked(spark, d):
    """The log arrives in three parts of equally many files, in the order of arrival; completed jobs
    leave by timer."""
    arriving, out, state = (scratch_path(spark) for _ in range(3))
    log = write_once(job_log(spark, d))
    ends = log.agg(F.min("seen_at").cast("double").alias("a"), F.max("seen_at").cast("double").alias("z")).first()
    third = F.floor((F.col("seen_at").cast("double") - ends.a) * 3 / (ends.z - ends.a + 1))
    sizes = dict(tuple(r) for r in log.groupBy(third).count().collect())      # a row a third
    least = min(sizes.get(part, 0) for part in range(3))
    # files of many rows each, dealt in turn: none is empty, so a batch is one part
    files = max(1, min(spark.sparkContext.defaultParallelism, least // ROWS_PER_FILE))
    for part in range(3):
        log.filter(third == part).repartition(files).write.mode("append").parquet(arriving)
    own = J.state_session(spark)
    stream = own.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(arriving)
    J.run_to_end(J.tracked_jobs(stream), out, state)
    return J.latest(spark.read.parquet(out))


@query("k4_merged_p95", """WITH e AS (SELECT event_type AS route, value AS v FROM events),
c AS (SELECT route, count(*) AS requests, round(avg(v), 6) AS mean_duration, max(v) AS max_duration FROM e GROUP BY route)
SELECT *, 1 AS p95_in_rank FROM c""")
def merged_p95(spark, d):
    """Hourly sketches merged per route: the quantile's true rank is within 0.2 % of 0.95."""
    events = I.table(spark, d, "events")
    merged = A.merge_routes(A.route_sketches(events), "route")
    rank = events.select(F.col("event_type").alias("route"), "value").join(merged, "route").groupBy("route").agg(
        (F.count_if(F.col("value") < F.col("p95_duration")) / F.count("value")).alias("below"),
        (F.count_if(F.col("value") <= F.col("p95_duration")) / F.count("value")).alias("upto"))
    near = (F.col("below") <= 0.952) & (F.col("upto") >= 0.948)
    return merged.join(rank, "route").select(
        "route", "requests", F.round("mean_duration", 6).alias("mean_duration"), "max_duration",
        near.cast("int").alias("p95_in_rank"))
