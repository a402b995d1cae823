"""Span operators on a (key, s, e) table with one row per span.

Years take few values, so spans are first reduced to distinct (key, s, e) with a
count.  That happens before the shuffle and bounds every window by the number of
possible spans, however many rows one key has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.functions.numeric import round_exact


def distinct_spans(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    return spans.groupBy(key, "s", "e").agg(F.count("*").alias("n"))


def merged_years(spans: DataFrame, claims: DataFrame | None = None,
                 key: str = "doc_id") -> DataFrame:
    """(key, islands, years): union length of the spans of a key, as gaps and islands.

    ``claims`` (key, claimed) adds the averaging rule; years are capped at 50.
    """
    order = Window.partitionBy(key).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    step = distinct_spans(spans, key).withColumn("reach", reach)
    out = step.groupBy(key).agg(
        F.count_if(F.col("reach").isNull() | (F.col("s") > F.col("reach"))).alias("islands"),
        F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest(
            F.col("s"), F.coalesce("reach", F.col("s"))))).alias("merged"))
    merged = F.coalesce(F.col("merged"), F.lit(0)).cast("double")
    if claims is None:
        years = merged
    else:
        out = out.join(claims, key, "full")
        years = F.when(F.col("claimed").isNull(), merged).when(
            merged > 0, (merged + F.col("claimed")) / 2).otherwise(F.col("claimed"))
    return out.select(key, F.coalesce("islands", F.lit(0)).alias("islands"),
                      round_exact(F.least(years, F.lit(50.0)), 1).alias("years"))


def overlap_pairs(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, overlaps): pairs of spans, ordered by (s, e), where the later one starts
    before the earlier one ends.

    A sweep, not a self-join: of the spans before j, those that end by s_j do not
    overlap it, and all spans that end by s_j are before j.
    """
    counted = distinct_spans(spans, key)
    order = Window.partitionBy(key).orderBy("s", "e")
    before = F.coalesce(F.sum("n").over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # ends sort ahead of starts of the same year: an end at s_j does not overlap j
    placed = counted.withColumn("before", before)
    marks = placed.select(key, "s", "e", "n", "before", F.inline(F.array(
        F.struct(F.col("e").alias("year"), F.lit(0).alias("is_start"), F.col("n").alias("ended")),
        F.struct(F.col("s").alias("year"), F.lit(1).alias("is_start"),
                 F.lit(0).cast("bigint").alias("ended")))))
    sweep = Window.partitionBy(key).orderBy("year", "is_start")
    closed = marks.withColumn("closed", F.sum("ended").over(sweep))
    n = F.col("n")
    point = F.col("s") == F.col("e")  # a point span is itself among the closed ones
    earlier = F.col("before") - (F.col("closed") - F.when(point, n).otherwise(F.lit(0)))
    same = F.when(point, F.lit(0)).otherwise(F.expr("n * (n - 1) div 2"))
    return closed.filter("is_start = 1").groupBy(key).agg(
        F.sum(n * earlier + same).cast("bigint").alias("overlaps"))


def year_gaps(years: DataFrame, key: str = "doc_id", compat: bool = False) -> DataFrame:
    """(key, gap_count, total_gap_years): steps over 2 between distinct years."""
    order = Window.partitionBy(key).orderBy("year")
    step = F.col("year") - F.lag("year").over(order)
    gap = F.when(step > 2, step)
    if compat:
        gap = F.lit(None).cast("int")
    return (years.select(key, "year").distinct().withColumn("gap", gap)
            .groupBy(key).agg(F.count("gap").alias("gap_count"),
                              F.coalesce(F.sum("gap"), F.lit(0)).alias("total_gap_years")))


def gap_list(years: DataFrame, key: str = "doc_id", longer_than: int = 2) -> DataFrame:
    """(key, from_year, to_year, years) of every gap."""
    order = Window.partitionBy(key).orderBy("year")
    return (years.select(key, "year").distinct()
            .withColumn("from_year", F.lag("year").over(order))
            .select(key, "from_year", F.col("year").alias("to_year"),
                    (F.col("year") - F.col("from_year")).alias("years"))
            .filter(F.col("years") > longer_than))


def latest_year(years: DataFrame, as_of_year: int, key: str = "doc_id") -> DataFrame:
    """(key, graduation_year): latest plausible year, as_of - 4 without one."""
    ok = F.col("year").between(1950, as_of_year)
    return years.groupBy(key).agg(F.coalesce(
        F.max(F.when(ok, F.col("year"))), F.lit(as_of_year - 4)).alias("graduation_year"))
