"""Stored analyses: append, history, delete, export, keyed inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import lexicon as L
from dossier.functions.text import norm_key
from dossier.session import write_once


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, failed): a row fails when it has an error and no classification."""
    bad = F.col("error").isNotNull() & F.col("classification").isNull()
    return df.filter(~bad), df.filter(bad)


def analysis_rows(results: DataFrame, username: str | None = None) -> DataFrame:
    """Result rows shaped for storage, with the defaults of the table."""
    have = set(results.columns)

    def col(name, default):
        value = F.lit(default)
        return F.coalesce(F.col(name), value) if name in have else value

    owner = F.col("username") if username is None else F.lit(username)
    return results.select(
        col("id", None).cast("bigint").alias("id"),
        col("job_id", None).cast("bigint").alias("job_id"),
        col("filename", "unknown").cast("string").alias("filename"),
        col("candidate_name", None).cast("string").alias("candidate_name"),
        owner.alias("username"),
        col("final_match_score", 0.0).cast("double").alias("final_match_score"),
        F.lit(0.5).alias("ai_plausibility_score"),
        col("classification", "Unknown").cast("string").alias("classification"),
        col("full_results", None).cast("string").alias("full_results"),
        (F.coalesce("created_at", F.current_timestamp()) if "created_at" in have
         else F.current_timestamp()).alias("created_at"))


ROWS_PER_FILE = 1_000_000    # rows from which on an owner's files are written by several tasks


def _gathered(rows: DataFrame) -> DataFrame:
    """Stored rows dealt over all tasks by owner, owners with very many rows in several parts.

    An owner's rows are a file each, so the files decide how long a write takes, not the
    bytes: parts made by size would leave many owners of few rows to one task.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    large = rows.groupBy("username").count().filter(F.col("count") > ROWS_PER_FILE).collect()
    part = F.coalesce(*[F.when(F.col("username").eqNullSafe(F.lit(r.username)),
                               F.pmod(F.xxhash64("id"), F.lit(-(-r["count"] // ROWS_PER_FILE))))
                        for r in large], F.lit(0))
    return rows.repartition(max(cores, -(-rows.count() // ROWS_PER_FILE)), "username", part)


def write_analyses(rows: DataFrame, path: str) -> None:
    """Append, laid out by owner so that a history reads its owner's files only.

    Rows are gathered by owner first, else every task would write a file per owner; they are
    written once before, since the owners are counted.
    """
    _gathered(write_once(rows)).write.mode("append").partitionBy("username").parquet(path)


def owned_by(df: DataFrame, user) -> DataFrame:
    return df.filter(F.col("username") == F.lit(user))


def history(df: DataFrame, user, limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of an owner's analyses, newest first (ties: higher id first)."""
    return (owned_by(df, user).orderBy(F.desc("created_at"), F.desc("id"))
            .offset(offset).limit(limit)
            .select("id", "filename", "candidate_name", "classification",
                    "final_match_score", "created_at", "full_results"))


def delete_analyses(df: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(remaining, not_found) for (id, username) keys; both parts must match."""
    on = ["id", "username"]
    return df.join(keys, on, "left_anti"), keys.join(df, on, "left_anti")


def read_analyses(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All stored rows; with ``schema``, files that lack a column have nulls in it."""
    reader = spark.read.schema(schema) if schema is not None else spark.read.option(
        "mergeSchema", "true")
    return reader.parquet(path)


def delete_stored(spark: SparkSession, path: str, keys: DataFrame,
                  schema: T.StructType | None = None) -> DataFrame:
    """Delete the rows of (id, username) ``keys`` from the stored analyses; the keys that were
    not found.

    Only owners with a deleted row are rewritten: their other rows go to the shared folder first,
    then replace the owners' folders.  Files of other owners stay as they are.
    """
    rows = read_analyses(spark, path, schema)
    keys = write_once(keys.select("id", "username").distinct())
    # the store is read once: the rows of the owners that the keys name, marked
    marked = write_once(rows.join(keys.select("username").distinct(), "username", "left_semi").join(
        keys.withColumn("_gone", F.lit(True)), ["id", "username"], "left").select(*rows.columns, "_gone"))
    hit = marked.filter("_gone").select("id", "username")
    owners = hit.select("username").distinct()
    kept = write_once(marked.filter("_gone is null").join(owners, "username", "left_semi")
                      .select(*rows.columns))
    (_gathered(kept).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("username").parquet(path))
    emptied = owners.join(kept.select("username").distinct(), "username", "left_anti")
    names = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for row in emptied.toLocalIterator():       # an overwrite leaves folders without rows alone
        folder = spark._jvm.org.apache.hadoop.fs.Path(
            path, f"username={names.escapePathName(row.username)}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return keys.join(hit, ["id", "username"], "left_anti")


def cascade_delete(df: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rows without a job, or whose job is still there."""
    return df.filter("job_id is null").unionByName(
        df.filter("job_id is not null").join(jobs.select("job_id"), "job_id", "left_semi")
        .select(*df.columns))


def with_jobs(df: DataFrame, jobs: DataFrame) -> DataFrame:
    return df.join(jobs.select("job_id", "title"), "job_id", "left")


def export_rows(df: DataFrame, user) -> DataFrame:
    return owned_by(df, user).select(
        "id", "filename", "classification", "final_match_score",
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))


def export_history(df: DataFrame, user, path: str, fmt: str = "csv") -> None:
    """An owner's history, newest first, as CSV with a header or as JSON."""
    rows = export_rows(df, user).orderBy(F.desc("created_at"), F.desc("id"))
    writer = rows.write.mode("overwrite")
    writer.json(path) if fmt == "json" else writer.option("header", True).csv(path)


def metrics_long(scores: DataFrame, report: DataFrame, importance: DataFrame) -> DataFrame:
    """(section, name, value): scores, per-class measures, importances to 6 places."""
    def long(df, section, key, cols):
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(section).alias("section"),
                     F.concat_ws(".", key, F.lit(c)).alias("name"),
                     F.round(c, 6).alias("value")) for c in cols])))

    one = scores.select(F.inline(F.array(*[
        F.struct(F.lit("1").alias("section"), F.lit(c).alias("name"),
                 F.round(c, 6).alias("value")) for c in ("accuracy", "f1_weighted")])))
    per = long(report, "1b", F.col("section"), ("precision", "recall", "f1"))
    two = importance.select(F.lit("2").alias("section"), F.col("feature").alias("name"),
                            F.round("importance", 6).alias("value"))
    return one.unionByName(per).unionByName(two)


def evolve_schema(df: DataFrame, target: T.StructType) -> DataFrame:
    """Every target column, added as null where the table lacks it."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in target], *[c for c in df.columns if c not in target.names])


def insert_if_absent(target: DataFrame, incoming: DataFrame, key: str,
                     order: str) -> DataFrame:
    """Incoming rows whose normalised key is new; one row per key, the first by ``order``.

    The first row is found by an aggregate with a partial step, so a key that fills the
    input costs one row per task.
    """
    first = (incoming.withColumn("_k", norm_key(F.col(key))).groupBy("_k")
             .agg(F.min_by(F.struct(*incoming.columns), order).alias("_r")))
    known = target.select(norm_key(F.col(key)).alias("_k")).distinct()
    return first.join(known, "_k", "left_anti").select("_r.*").withColumn(
        key, norm_key(F.col(key)))


def exists_by_key(probe: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Probe rows with a match on all keys."""
    return probe.join(df.select(*keys), keys, "left_semi")


def write_features(df: DataFrame, path: str) -> None:
    df.select("doc_id", "job_id", *L.FEATURES).write.mode("overwrite").parquet(path)
