"""Repeated runs of lines by winnowing.

The fingerprints of a text are the least line hashes of all windows of ``run`` lines, so any
run of that length that two texts share has a fingerprint in common, at the same
place in the run.  Positions are joined over their fingerprint: a window is compared further
only when its fingerprint stands at several positions.  Such windows are compared in full, and
every window that has an earlier copy (by document and place) is a match; matches that
touch or overlap extend each other, forwards and backwards, to maximal runs.  The later runs are
deleted, the first stays.

The guarantee depends on content too: fewer lines also make a window when they have ``words``
words, and so do all lines of a text with fewer than ``run``.  Only ``words=None`` looks at runs
of ``run`` lines alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.llm.common import quoted, text_of, whole_row, written

RUN, WORDS = 3, 50
WORD = r"[^ \t\n\x0B\f\r]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _content(text: Column) -> Column:
    """(line, at): trimmed lines that are not blank, with their number from 0."""
    return F.filter(F.transform(_lines(text), lambda x, i: F.struct(
        F.trim(x).alias("line"), i.alias("at"))), lambda x: x.line != "")


def _mark(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), text_of(text_col))


def _windows(docs: DataFrame, run: int, words: int | None, id_col: str,
             text_col: str) -> DataFrame:
    """Written (id, mark, start, stop, first, last, fingerprint, at, content) of every window:
    its places among the lines that are not blank, and its line numbers."""
    lines = docs.select(F.col(id_col).alias("id"), _mark(id_col, text_col).alias("mark"),
                        _content(text_of(text_col)).alias("lines")).filter(
        F.size("lines") >= (run if words is None else 1))
    hashed = lines.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x.line)))
    if words is not None:
        hashed = hashed.withColumn("counts", F.transform(
            "lines", lambda x: F.regexp_count(x.line, F.lit(WORD))))

    def window(s, size):
        part, least = F.slice("lines", s, size), F.array_min(F.slice("hashes", s, size))
        return F.struct(
            s.alias("start"), (s + F.lit(size - 1)).alias("stop"),
            F.element_at(part, 1).at.alias("first"),
            F.element_at(part, size).at.alias("last"), least.alias("fingerprint"),
            F.array_position(F.slice("hashes", s, size), least).alias("at"),
            F.unhex(F.md5(F.array_join(F.transform(part, lambda x: x.line), "\n")))
            .alias("content"))

    def of(size):
        starts = F.when(F.size("lines") >= size, F.sequence(
            F.lit(1), F.size("lines") - F.lit(size - 1))).otherwise(F.array().cast("array<int>"))
        if size < run:
            starts = F.filter(starts, lambda s: (F.size("lines") == size) | (F.aggregate(
                F.slice("counts", s, size), F.lit(0), lambda n, x: n + x) >= words))
        return F.transform(starts, lambda s: window(s, size))

    sizes = [run] if words is None else range(1, run + 1)
    return written(hashed.select("id", "mark", F.explode(F.concat(*map(of, sizes))).alias("w"))
                   .select("id", "mark", "w.*"))


def repeated_runs(docs: DataFrame, run: int = RUN, id_col: str = "doc_id",
                  text_col: str = "text", words: int | None = WORDS) -> DataFrame:
    """(id, mark, first, last, source_id): the later runs of every document.

    ``first`` and ``last`` are line numbers from 0; a run has ``run`` or more lines that are not
    blank, and lines are compared trimmed.  With ``words``, fewer lines are a run too when they
    have ``words`` words (without ASCII white space) or are all lines of both texts.
    ``source_id`` is the document with the first copy of the run's first window.  Null
    and blank texts have no runs, nor have shorter ones without ``words``.  A null id comes
    last in the order.  Rows equal in id and text share a mark and count as one document.
    """
    windows = _windows(docs, run, words, id_col, text_col)
    place = F.xxhash64("mark", F.col("start") + F.col("at"))     # more than one, when they differ
    shared = (windows.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b"))
              .filter("a <> b").select("fingerprint"))
    own = F.struct(F.col("id").isNull().alias("late"), "id", "mark", "start", "stop", "first",
                   "last")
    matched = windows.join(shared, "fingerprint", "left_semi").select(
        "content", own.alias("own"))
    first = (matched.groupBy("content").agg(F.min("own").alias("head"),
                                            F.max("own").alias("tail"))
             .filter(F.col("head") != F.col("tail")).select("content", "head"))
    later = matched.join(first, "content").filter(F.col("own") != F.col("head")).select(
        "own.*", F.col("head.id").alias("source_id")).distinct()
    order = Window.partitionBy("mark", "id").orderBy("start", "stop").rowsBetween(
        Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("start") > F.max("stop").over(order) + 1, F.lit(True))
    order = order.rowsBetween(Window.unboundedPreceding, 0)
    return (later.withColumn("island", F.sum(apart.cast("int")).over(order))
            .groupBy("id", "mark", "island").agg(
                F.min("first").alias("first"), F.max("last").alias("last"),
                F.min(F.struct("start", "stop", "source_id")).alias("head"))
            .select("id", "mark", "first", "last", F.col("head.source_id").alias("source_id")))


def cut_runs(docs: DataFrame, run: int = RUN, id_col: str = "doc_id",
             text_col: str = "text", words: int | None = WORDS) -> DataFrame:
    """All rows and columns, and ``removed_runs`` array<(first, last)>; the runs' lines are
    cut out of the text.

    A text without runs, null included, stays as it is.  A column ``removed_runs`` is replaced.
    """
    runs = (repeated_runs(docs, run, id_col, text_col, words).groupBy("mark")
            .agg(F.collect_list(F.struct("first", "last")).alias("runs")))
    joined = docs.select(whole_row(docs.columns).alias("row"),
                         _mark(id_col, text_col).alias("mark")).join(runs, "mark", "left")
    kept = F.filter(_lines(text_of(f"row.{text_col}")), lambda x, i: ~F.exists(
        "runs", lambda r: i.between(r.first, r.last)))
    return joined.select(
        *[F.when(F.col("runs").isNotNull(), F.array_join(kept, "\n"))
          .otherwise(F.col(f"row.{quoted(c)}")).alias(c) if c == text_col
          else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c != "removed_runs"],
        F.coalesce("runs", F.array().cast("array<struct<first:int,last:int>>"))
        .alias("removed_runs"))
