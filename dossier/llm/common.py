"""Shared pieces of the corpus operators: hot keys and text columns; ``written`` cuts lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import write_once as written  # noqa: F401

# A key is hot when it holds more than one HOT_SHARE-th of all rows, so there are
# fewer than HOT_SHARE hot keys whatever the input: their table may be broadcast.
HOT_SHARE = 1024
SALTS = 256

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str) -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def quoted(name: str) -> str:
    """A column's name as a reference, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(names) -> Column:
    """One struct of the columns."""
    return F.struct(*[F.col(quoted(name)) for name in names])


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def hot_keys(keys: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """The values of ``key`` held by more than 1/share of all rows: fewer than ``share`` rows."""
    least = keys.count() // share
    return (keys.groupBy(key).agg(F.count(F.lit(1)).alias("copies"))
            .filter((F.col("copies") > least) & (F.col("copies") > 1)).select(key))


def attach(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Inner join of written rows with a table that has ``key`` once: rows of hot keys meet a
    broadcast of their fewer than HOT_SHARE entries, the others are merged, by hint: a table of
    one entry a row may look small enough to be sent through the driver."""
    hot = F.broadcast(small.join(F.broadcast(hot_keys(rows, key)), key, "left_semi"))
    cold = rows.join(hot.select(key), key, "left_anti").join(small.hint("merge"), key)
    return cold.unionByName(rows.join(hot, key))
