"""Dataset profiling: distributions, statistics, correlations, reports."""

from __future__ import annotations

import struct
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossier.functions.numeric import round_exact, share
from dossier.session import write_once


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n, percent) of a column, nulls left out."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(
        F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("value", "n", (F.col("n") * 100 / total).alias("percent"))


def value_counts_rollup(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts of every prefix of ``cols`` with a grand total."""
    return df.rollup(*cols).agg(F.count("*").alias("n"))


def _long(df: DataFrame, cols: list[str], measures: dict[str, object]) -> DataFrame:
    """One aggregation pass, then one row per column."""
    wide = df.agg(*[make(F.col(c)).alias(f"{c}__{m}")
                    for c in cols for m, make in measures.items()])
    rows = [F.struct(F.lit(c).alias("feature"),
                     *[F.col(f"{c}__{m}").alias(m) for m in measures]) for c in cols]
    return wide.select(F.inline(F.array(*rows)))


def feature_stats(df: DataFrame, cols: list[str], digits: int = 4) -> DataFrame:
    """(feature, n, mean, std, min, max); columns that are absent are skipped."""
    have = [c for c in cols if c in df.columns]

    def rounded(f):
        return lambda c: round_exact(f(c.cast("double")), digits)

    return _long(df, have, {
        "n": F.count, "mean": rounded(F.avg), "std": rounded(F.stddev_samp),
        "min": rounded(F.min), "max": rounded(F.max)})


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return _long(df, cols, {"nulls": lambda c: F.count_if(c.isNull())})


def class_means(df: DataFrame, label: str, cols: list[str], digits: int = 4) -> DataFrame:
    return df.groupBy(label).agg(*[
        round_exact(F.avg(F.col(c).cast("double")), digits).alias(c) for c in cols])


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r): Pearson correlation of every pair of columns, one pass."""
    pairs = list(combinations(cols, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
                    for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"))
        for i, (a, b) in enumerate(pairs)])))


RADIX = 16      # bits decided per pass
EXPONENT = 1023


def ordered_bits(value: Column) -> Column:
    """A long that orders doubles as their values do, and tells any two of them apart.

    It is the double's own bit pattern, negated for negative numbers: the exponent is found by
    a logarithm and corrected where that is off by one; all other steps are exact.
    """
    size = F.abs(value)
    # the logarithm of 0 and of infinity are cut off before the cast, and not used
    near = F.greatest(F.lit(1 - EXPONENT).cast("long"), F.least(
        F.lit(EXPONENT).cast("long"), F.floor(F.log2(size)))).cast("int")
    part = lambda e: size / F.pow(F.lit(2.0), e)                                    # noqa: E731
    exponent = (near + F.when(part(near) >= 2, 1).otherwise(0)
                - F.when(part(near) < 1, 1).otherwise(0))
    normal = ((exponent + EXPONENT).cast("long") * F.lit(1 << 52)
              + ((part(exponent) - 1) * F.lit(float(1 << 52))).cast("long"))
    tiny = (size * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")
    bits = (F.when(F.isnan(value), F.lit((2047 << 52) + 1))
            .when(size == float("inf"), F.lit(2047 << 52))
            .when(size < F.lit(2.0 ** -1022), tiny).otherwise(normal))
    return F.when(value < 0, -bits).otherwise(bits)


def double_of(bits: int) -> float:
    """The double of ``ordered_bits``."""
    value = struct.unpack("<d", struct.pack("<q", abs(bits)))[0]
    return -value if bits < 0 else value


def order_statistics(df: DataFrame, cols: list[str], ranks: dict[str, list[int]]) -> dict:
    """Per column the values of the given ranks (from 0, nulls left out, NaN last).

    Radix selection on ordered bit patterns: four passes of 16 bits for all columns and ranks
    together, whatever the values and the table's size.  The patterns are written once.  A pass
    counts the next bits of the rows that share a searched prefix: at most 65,536 counts
    per prefix are ever sorted, and one row per rank reaches the driver.
    """
    # (column number, rank) -> (known leading bits, rank among the rows that have them)
    state = {(i, r): (0, r) for i, c in enumerate(cols) for r in ranks[c]}
    if not state:
        return {c: {} for c in cols}
    spark = df.sparkSession
    bits = write_once(df.select(*[ordered_bits(F.col(c).cast("double")).alias(f"k{i}")
                                  for i, c in enumerate(cols)]))
    keys = [bits[f"k{i}"] for i in range(len(cols))]
    for shift in range(64 - RADIX, -1, -RADIX):
        seen = []
        for i, c in enumerate(cols):
            leads = sorted({lead for (j, _), (lead, _) in state.items() if j == i})
            if not leads:
                continue
            # the first digit carries the sign; before it every row is searched
            lead = F.shiftright(keys[i], shift + RADIX) if shift + RADIX < 64 else F.lit(0).cast("long")
            seen.append(F.when(keys[i].isNotNull() & lead.isin(leads), F.struct(
                F.lit(i).alias("i"), F.shiftright(keys[i], shift).alias("bits"))))
        counts = (bits.select(F.explode(F.array(*seen)).alias("x")).filter("x is not null")
                  .groupBy("x.i", "x.bits").agg(F.count(F.lit(1)).alias("n")))
        lead = F.shiftright("bits", RADIX) if shift + RADIX < 64 else F.lit(0).cast("long")
        upto = F.sum("n").over(Window.partitionBy("i", "lead").orderBy("bits"))
        sought = spark.createDataFrame([(i, r, lead, at) for (i, r), (lead, at) in state.items()],
                                       "i int, rank long, lead long, at long")
        found = (counts.withColumn("lead", lead).withColumn("upto", upto)
                 .join(F.broadcast(sought), ["i", "lead"])     # as many rows as ranks
                 .filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at")))
                 .select("i", "rank", "bits", (F.col("at") - F.col("upto") + F.col("n")).alias("at")))
        state = {(r.i, r.rank): (r.bits, r.at) for r in found.collect()}
    out: dict = {c: {} for c in cols}
    for (i, r), (bits, _) in state.items():
        out[cols[i]][r] = double_of(bits)
    return out


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Per column its exact quantiles, with linear interpolation between neighbours; None for a
    column without values."""
    sizes = df.agg(*[F.count(F.col(c).cast("double")).alias(f"n{i}")
                     for i, c in enumerate(cols)]).first()
    places = {c: [p * (sizes[f"n{i}"] - 1) for p in probs] if sizes[f"n{i}"] else []
              for i, c in enumerate(cols)}
    ranks = {c: sorted({r for at in found for r in (int(at), -int(-at // 1))})
             for c, found in places.items()}
    known = order_statistics(df, cols, ranks)
    out = {}
    for c, found in places.items():
        out[c] = [None] * len(probs) if not found else [
            a if at == int(at) else a + (b - a) * (at - int(at))
            for at in found for a, b in [(known[c][int(at)], known[c][-int(-at // 1)])]]
    return out


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, n, mean, std, min, q25, q50, q75, max) with exact quartiles."""
    basic = {"n": F.count, "mean": lambda c: F.avg(c.cast("double")),
             "std": lambda c: F.stddev_samp(c.cast("double")),
             "min": lambda c: F.min(c.cast("double")), "max": lambda c: F.max(c.cast("double"))}
    quart = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    found = exact_quantiles(df, cols, list(quart.values()))

    def known(m):
        i = list(quart).index(m)
        return F.coalesce(*[F.when(F.col("feature") == c, F.lit(q[i]).cast("double"))
                            for c, q in found.items()])

    return _long(df, cols, basic).select("*", *[known(m).alias(m) for m in quart])


def impute_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls become the exact column median."""
    medians = exact_quantiles(df, cols, [0.5])
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(m[0]).cast("double"))
        for c, m in medians.items()})


def numeric_or_median(df: DataFrame, names: list[str]) -> DataFrame:
    """Training columns: text coerced to numbers, median for the rest, absent -> 0.0."""
    have = [n for n in names if n in df.columns]
    cast = df.withColumns({n: F.col(n).try_cast("double") for n in have})
    filled = impute_median(cast, have) if have else cast
    return filled.withColumns({n: F.lit(0.0) for n in names if n not in df.columns})


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(y, yhat, n) for the combinations that occur."""
    return df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(
        F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, y: str, yhat: str, labels: list) -> DataFrame:
    """One row per true label, one column per predicted label."""
    return df.groupBy(F.col(y).alias("y")).agg(*[
        F.count_if(F.col(yhat) == F.lit(v)).alias(f"pred_{v}") for v in labels])


def _per_class(counts: DataFrame) -> DataFrame:
    hit = F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(F.lit(0))
    sides = counts.select(F.inline(F.array(
        F.struct(F.col("y").alias("label"), hit.alias("tp"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted")),
        F.struct(F.col("yhat").alias("label"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted")))))
    summed = sides.groupBy("label").agg(*[
        F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    p, r = share(F.col("tp"), F.col("predicted")), share(F.col("tp"), F.col("support"))
    return summed.select(
        "label", "tp", "support", p.alias("precision"), r.alias("recall"),
        share(F.lit(2.0) * p * r, p + r).alias("f1"))


def classification_report(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(section, precision, recall, f1, support): per class, macro and weighted."""
    per = _per_class(confusion(df, y, yhat))
    measures = ["precision", "recall", "f1"]

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / F.sum("support")

    rows = per.select(F.col("label").cast("string").alias("section"), *measures, "support")
    macro = per.agg(*[F.avg(c).alias(c) for c in measures], F.sum("support").alias("support"))
    mean = per.agg(*[weighted(c).alias(c) for c in measures], F.sum("support").alias("support"))
    return (rows.unionByName(macro.select(F.lit("macro avg").alias("section"), "*"))
            .unionByName(mean.select(F.lit("weighted avg").alias("section"), "*")))


def scores(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(accuracy, f1_weighted, n) in one row."""
    per = _per_class(confusion(df, y, yhat))
    return per.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.sum("support").alias("n"))


def class_histogram(df: DataFrame, label: str, col: str, bins: int = 20) -> DataFrame:
    """(label, bucket, n): equal-width bins between the column's bounds."""
    v = F.col(col).cast("double")
    lo, hi = df.agg(F.min(v)).scalar(), df.agg(F.max(v)).scalar()
    width = (hi - lo) / F.lit(float(bins))
    raw = F.floor(F.try_divide(v - lo, width)).cast("int")
    return (df.filter(v.isNotNull())
            .select(F.col(label).alias("label"),
                    F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).alias("bucket"))
            .groupBy("label", "bucket").agg(F.count("*").alias("n")))
