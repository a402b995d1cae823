"""Session helpers: a local builder for tests and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "dossier", **conf) -> SparkSession:
    """A single-machine session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DOSSIER_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder of its own.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="dossier-checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once and re-read from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


_FOLDERS: dict[str, str] = {}


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the session's file system closes."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS[app])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{_FOLDERS[app]}/{uuid.uuid4().hex}"


def write_once(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them from there.

    Cuts the lineage like a checkpoint, survives lost executors, and later reads fetch
    only the columns they use.
    """
    where = scratch_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


ROWS_PER_TASK = 25_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """For tests and benches on one machine: hash-partition a small file over the cores.

    A file with one row group is one part, which would put all text work on one core.  On a
    cluster the reader's split size decides and the table is returned as it is.
    """
    sc = df.sparkSession.sparkContext
    if not sc.master.startswith("local["):
        return df
    return df.repartition(sc.defaultParallelism, *keys)


def spread_rows(df: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Deal narrow rows that much work follows over as many tasks as their number asks for.

    The reader splits by bytes and never inside a row group, so a small file of many short
    rows would be one task on any cluster.  Every column takes part in the hash, so a key
    that repeats does not fill one task.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, *df.columns)
