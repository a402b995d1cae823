"""Progress, quotas, request statistics and expiry over event tables or streams.

Every function takes a batch table or a stream; the aggregation is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: requests per minute
QUOTAS = {"applicant": 10, "single": 25, "batch": 100}
TTL_MINUTES = 30


def batch_progress(items: DataFrame, totals: DataFrame | None = None,
                   job: str = "job_id") -> DataFrame:
    """Per job: completed items, errors, total, percent (0 for an empty job), status.

    ``items`` has one row per finished item with ``status``.  ``totals`` (job, total)
    gives the announced sizes; without it every item seen counts as announced.
    """
    done = F.col("status").isin("completed", "error")
    counts = items.groupBy(job).agg(
        F.count_if(done).alias("completed"), F.count_if(F.col("status") == "error").alias("errors"),
        F.count("*").alias("seen"))
    if totals is None:
        counts = counts.withColumnRenamed("seen", "total")
    else:
        counts = counts.drop("seen").join(totals, job)
    percent = F.when(F.col("total") > 0, F.round(F.col("completed") * 100.0 / F.col("total"))
                     ).otherwise(F.lit(0.0)).cast("bigint")
    return counts.select(
        job, "completed", "errors", F.col("total").cast("bigint").alias("total"),
        percent.alias("progress"),
        F.when(F.col("completed") >= F.col("total"), "completed").otherwise(
            "processing").alias("status"))


def quota_usage(events: DataFrame, quota: int | Column, client: str = "user_id",
                watermark: str = "10 minutes") -> DataFrame:
    """Per client and minute: requests and whether they exceed the quota."""
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    limit = F.lit(quota) if isinstance(quota, int) else quota
    return (source.groupBy(F.window("ts", "1 minute").alias("w"), F.col(client).alias("client"))
            .agg(F.count("*").alias("requests"))
            .select("client", F.col("w.start").alias("minute"), "requests",
                    (F.col("requests") > limit).alias("over_quota")))


def route_statistics(events: DataFrame, route: str = "event_type", duration: str = "value",
                     every: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Per route and window: requests, mean, largest and 95th percentile duration."""
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    return (source.groupBy(F.window("ts", every).alias("w"), F.col(route).alias("route"))
            .agg(F.count("*").alias("requests"), F.avg(duration).alias("mean_duration"),
                 F.max(duration).alias("max_duration"),
                 F.percentile_approx(duration, 0.95, 10000).alias("p95_duration"))
            .select("route", F.col("w.start").alias("start"), "requests", "mean_duration",
                    "max_duration", "p95_duration"))


SKETCH = 4096       # rank error of a quantile below 0.1 %


def route_sketches(events: DataFrame, route: str = "event_type", duration: str = "value",
                   every: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Per route and window what longer windows can be merged from: requests, sum and largest
    duration, and a quantile sketch of bounded size."""
    source = events.withWatermark("ts", watermark) if events.isStreaming else events
    value = F.col(duration).cast("double")
    return (source.groupBy(F.window("ts", every).alias("w"), F.col(route).alias("route"))
            .agg(F.count("*").alias("requests"), F.count(value).alias("timed"),
                 F.sum(value).alias("duration"), F.max(value).alias("max_duration"),
                 F.kll_sketch_agg_double(value, F.lit(SKETCH)).alias("sketch"))
            .select("route", F.col("w.start").alias("start"), "requests", "timed", "duration",
                    "max_duration", "sketch"))


def merge_routes(sketches: DataFrame, *keys: str, quantile: float = 0.95) -> DataFrame:
    """(keys, requests, mean_duration, max_duration, p95_duration) of merged windows."""
    merged = sketches.groupBy(*keys).agg(
        F.sum("requests").alias("requests"), F.sum("timed").alias("timed"),
        F.sum("duration").alias("duration"), F.max("max_duration").alias("max_duration"),
        F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))
    return merged.select(
        *keys, "requests", F.try_divide("duration", "timed").alias("mean_duration"), "max_duration",
        F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(quantile)))
        .alias("p95_duration"))


def live_jobs(jobs: DataFrame, now: Column, ttl_minutes: int = TTL_MINUTES) -> DataFrame:
    """Drops completed jobs created more than ``ttl_minutes`` before ``now``."""
    old = (F.unix_timestamp(now) - F.unix_timestamp("created_at")) > ttl_minutes * 60
    return jobs.filter(~((F.col("status") == "completed") & old))


def first_per_key(rows: DataFrame, key: str, watermark: str = "30 minutes") -> DataFrame:
    """At most one row per key: the earliest in a table; on a stream the first to
    arrive within the watermark."""
    if rows.isStreaming:
        return rows.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])
    picked = F.min_by(F.struct(*rows.columns), F.struct("ts", *[
        c for c in rows.columns if c not in ("ts", key)]))
    return rows.groupBy(F.col(key).alias("_k")).agg(picked.alias("_r")).select("_r.*")
