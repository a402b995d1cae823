"""Exact duplicates by sorting the content itself.

Texts are range-partitioned by their normalised bytes, each range is sorted externally, and
equal texts end up adjacent: the window operator compares every text with its neighbour in
full.  The splitters come from a sample that the range exchange draws; they are made of the
first HEAD characters and a hash of the whole text, so that the sample stays small however
long the texts are, and texts with a common head spread over several ranges.

A text that holds more than 1/HOT_SHARE of all rows would fill one range by itself.  Such
texts get a salt as second sort key, so their copies spread over SALTS runs; the runs
are reduced first and then merged, one row per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import SALTS, ascii_lower, hot_keys, text_of, whole_row, written

HEAD = 64


def _split(docs: DataFrame, id_col: str, text_col: str, carry) -> tuple[DataFrame, DataFrame]:
    """(cold, hot) rows as (row, id, norm, salt); hot texts are salted.

    Hot texts are found by a hash that ignores all case, so a collision only salts a
    text needlessly.
    """
    mark = F.xxhash64(F.lower(text_of(text_col)))
    hot = F.broadcast(hot_keys(docs.select(mark.alias("_mark")), "_mark"))
    rows = docs.select(whole_row(carry).alias("row"), F.col(id_col).alias("id"),
                       text_of(text_col).alias("norm"), mark.alias("_mark"))
    cold = rows.join(hot, "_mark", "left_anti").withColumn("salt", F.lit(0))
    warm = rows.join(hot, "_mark", "left_semi").withColumn(
        "salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return tuple(part.select("row", "id", ascii_lower(F.col("norm")).alias("norm"), "salt")
                 for part in (cold, warm))


def _first(keep: str, column: str = "id") -> Column:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    return (F.col(column).asc_nulls_last() if keep == "smallest"
            else F.col(column).desc_nulls_last())


def _runs(rows: DataFrame, keep: str, salted: bool) -> DataFrame:
    """Content sort: every row with its run's winner (place 1), winning id and length."""
    # a constant salt would not count as a key, and the ranges would be hashed anew
    salt = ["salt"] if salted else []
    same = Window.partitionBy("norm", "head", "digest", *salt)
    ranked = same.orderBy(_first(keep))
    return (rows.withColumn("head", F.substring("norm", 1, HEAD))
            .withColumn("digest", F.xxhash64("norm"))
            .repartitionByRange("head", "digest", *salt)
            .select("row", "id", "norm", "salt", F.row_number().over(ranked).alias("place"),
                    F.first("id").over(ranked).alias("keep_id"),
                    F.count(F.lit(1)).over(same).alias("size")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 keep: str = "smallest") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  A null text counts as empty;
    a null id is never preferred over another.  Of repeated rows with one id exactly
    one is kept.  An empty table gives no rows.
    """
    cold, hot = _split(docs, id_col, text_col, [id_col])
    done = _runs(cold, keep, False).select(
        "id", "keep_id", F.col("size").alias("group_size"), (F.col("place") == 1).alias("kept"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"))
    runs = written(_runs(hot, keep, True).select(
        "id", "keep_id", "size", "place", "salt",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")))
    best = F.min if keep == "smallest" else F.max
    # one row per hot text; the run that wins a tie of ids is the one with the least salt
    heads = runs.filter(F.col("place") == 1)
    order = Window.partitionBy("text_sha256").orderBy(_first(keep, "keep_id"), "salt")
    merged = (heads.withColumn("n", F.row_number().over(order)).groupBy("text_sha256").agg(
        best("keep_id").alias("keep_id"), F.sum("size").alias("group_size"),
        F.min(F.when(F.col("n") == 1, F.col("salt"))).alias("winner")))
    hot_rows = runs.select("id", "place", "salt", "text_sha256").join(
        F.broadcast(merged), "text_sha256").select(
        "id", "keep_id", "group_size",
        ((F.col("place") == 1) & (F.col("salt") == F.col("winner"))).alias("kept"), "text_sha256")
    return done.unionByName(hot_rows).select(F.col("id").alias(id_col), "keep_id", "group_size",
                                             "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "smallest") -> DataFrame:
    """The rows that stay, with all their columns; cases as in ``exact_groups``."""
    cold, hot = _split(docs, id_col, text_col, docs.columns)
    merged = Window.partitionBy("norm").orderBy(_first(keep), "salt")
    heads = _runs(hot, keep, True).filter(F.col("place") == 1).select(
        "row", F.row_number().over(merged).alias("place"))
    return (_runs(cold, keep, False).select("row", "place").unionByName(heads)
            .filter(F.col("place") == 1).select("row.*"))
