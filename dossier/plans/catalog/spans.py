"""Year spans, gaps and graduation, in text and as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossier.functions import spans as S
from dossier.functions import text as X
from dossier.operators import spantables as ST
from dossier.plans import inputs as I
from dossier.plans.catalog import duck as D
from dossier.plans.catalog import query
from dossier.plans.catalog.text import PROFILES, folded, profiles

Y = I.AS_OF


def _spans_sql(rule):
    return f"{PROFILES}, s AS (SELECT doc_id, f, {D.spans('f', Y, rule)} AS sp FROM f)"


def _with_spans(spark, d, rule):
    return profiles(spark, d).select("doc_id", "folded", S.extract_spans(folded(), Y, rule).alias("sp"))


def _exploded(name, rule):
    @query(name, f"{_spans_sql(rule)}, u AS (SELECT doc_id, unnest(sp) AS x FROM s) "
           "SELECT doc_id, x.s AS s, x.e AS e FROM u")
    def run(spark, d):
        return _with_spans(spark, d, rule).select("doc_id", F.inline_outer("sp")).filter("s is not null")


_exploded("i1_extract_spans", "experience")
_exploded("i3_extract_spans_dash", "overlap")


@query("i2_years_experience", f"{_spans_sql('experience')}, m AS (SELECT doc_id, sp, {D.claimed_years('f')} AS claimed FROM s) "
       f"SELECT doc_id, {D.years_experience('sp', 'claimed')} AS years FROM m")
def years(spark, d):
    return _with_spans(spark, d, "experience").select(
        "doc_id", S.years_experience(F.col("sp"), X.claimed_years(folded())).alias("years"))


@query("i4_overlap_pairs", f"{_spans_sql('overlap')} SELECT doc_id, {D.overlap_pairs('sp')} AS overlaps FROM s")
def overlaps(spark, d):
    return _with_spans(spark, d, "overlap").select("doc_id", S.overlap_pairs(F.col("sp")).alias("overlaps"))


# spans as a table: a customer's years of activity by order priority
SPANS_SQL = ("spans AS (SELECT o_custkey AS doc_id, min(year(o_orderdate)) AS s, max(year(o_orderdate)) AS e "
             "FROM orders GROUP BY o_custkey, o_orderpriority)")


def order_spans(spark, d):
    y = F.year("o_orderdate")
    return (I.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id"), "o_orderpriority")
            .agg(F.min(y).alias("s"), F.max(y).alias("e")).select("doc_id", "s", "e"))


@query("i2_merged_years_table", f"""WITH {SPANS_SQL},
r AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r),
h AS (SELECT doc_id, island, max(e) - min(s) AS len FROM g GROUP BY ALL)
SELECT doc_id, count(*) AS islands, least(CAST(sum(len) AS DOUBLE), 5e1) AS years FROM h GROUP BY doc_id""")
def merged_table(spark, d):
    return ST.merged_years(order_spans(spark, d))


@query("i4_overlap_pairs_table", f"""WITH {SPANS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS k FROM spans),
c AS (SELECT a.doc_id, count(*) AS pairs FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.k < b.k AND b.s < a.e GROUP BY a.doc_id)
SELECT doc_id, coalesce(pairs, 0) AS overlaps FROM (SELECT DISTINCT doc_id FROM n) LEFT JOIN c USING (doc_id)""")
def overlap_table(spark, d):
    return ST.overlap_pairs(order_spans(spark, d))


# every order as a span: one customer may own any share of the rows
@query("i4_overlap_pairs_orders", """WITH spans AS (SELECT o_custkey AS doc_id, year(o_orderdate) - o_orderkey % 3 AS s, year(o_orderdate) + o_orderkey % 2 AS e FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS k FROM spans),
c AS (SELECT a.doc_id, count(*) AS pairs FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.k < b.k AND b.s < a.e GROUP BY a.doc_id)
SELECT doc_id, coalesce(pairs, 0) AS overlaps FROM (SELECT DISTINCT doc_id FROM n) LEFT JOIN c USING (doc_id)""")
def overlap_orders(spark, d):
    rows = I.table(spark, d, "orders").selectExpr(
        "o_custkey AS doc_id", "cast(year(o_orderdate) - o_orderkey % 3 as int) AS s",
        "cast(year(o_orderdate) + o_orderkey % 2 as int) AS e")
    return ST.overlap_pairs(rows)


# ------------------------------------------------------------- gaps, years
_years = f"{PROFILES}, y AS (SELECT doc_id, f, {D.mentioned_years('f')} AS ys FROM f)"
_steps = "list_filter(list_transform(ys, lambda v, i: v - ys[i - 1]), lambda s: s > 2)"


def _with_years(spark, d):
    return profiles(spark, d).select("doc_id", "folded", S.mentioned_years(folded()).alias("ys"))


@query("i5_year_gaps", f"{_years} SELECT doc_id, len({_steps}) AS gap_count, CAST(coalesce(list_sum({_steps}), 0) AS BIGINT) AS total_gap_years FROM y")
def gaps(spark, d):
    g = S.year_gaps(F.col("ys"))
    return _with_years(spark, d).select("doc_id", g.gap_count.alias("gap_count"), g.total_gap_years.alias("total_gap_years"))


ORDER_YEARS = "SELECT DISTINCT o_custkey AS doc_id, year(o_orderdate) AS year FROM orders"


@query("i5_year_gaps_table", f"""WITH y AS ({ORDER_YEARS}), g AS (SELECT doc_id, year - lag(year) OVER (PARTITION BY doc_id ORDER BY year) AS step FROM y)
SELECT doc_id, count(CASE WHEN step > 2 THEN 1 END) AS gap_count, CAST(coalesce(sum(CASE WHEN step > 2 THEN step END), 0) AS BIGINT) AS total_gap_years FROM g GROUP BY doc_id""")
def gaps_table(spark, d):
    return ST.year_gaps(order_years(spark, d))


def order_years(spark, d):
    return I.table(spark, d, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.year("o_orderdate").alias("year"))


@query("i5_gap_list", f"""WITH y AS ({ORDER_YEARS}), g AS (SELECT doc_id, lag(year) OVER (PARTITION BY doc_id ORDER BY year) AS from_year, year AS to_year FROM y)
SELECT doc_id, from_year, to_year, to_year - from_year AS years FROM g WHERE to_year - from_year > 1""")
def gap_rows(spark, d):
    return ST.gap_list(order_years(spark, d), longer_than=1)


@query("i6_graduation_year", f"{PROFILES} SELECT doc_id, {D.graduation_year('f', Y)} AS graduation_year FROM f")
def graduation(spark, d):
    return profiles(spark, d).select("doc_id", S.graduation_year(folded(), Y).alias("graduation_year"))


def _promotion(name, compat):
    n = ("len(list_distinct(list_transform(ys, lambda v: v // 100)))" if compat else "len(ys)")
    speed = D.round_exact(f"{D.promotion_keywords('f')} / CAST({n} AS DOUBLE)", 4)

    @query(name, f"{_years} SELECT doc_id, CASE WHEN {n} > 1 THEN {speed} ELSE 0e0 END AS speed FROM y")
    def run(spark, d):
        return _with_years(spark, d).select("doc_id", S.promotion_speed(folded(), F.col("ys"), compat).alias("speed"))


_promotion("i7_promotion_speed", False)
_promotion("i7_promotion_speed_compat", True)


@query("i8_graduation_gap", f"{_spans_sql('experience')}, m AS (SELECT doc_id, sp, f, {D.claimed_years('f')} AS claimed FROM s), "
       f"v AS (SELECT doc_id, {D.years_experience('sp', 'claimed')} AS years, {D.graduation_year('f', Y)} AS grad FROM m) "
       f"SELECT doc_id, {D.round_exact(f'({Y} - grad) - years', 2)} AS gap FROM v")
def grad_gap(spark, d):
    staged = _with_spans(spark, d, "experience").select(
        "doc_id", S.years_experience(F.col("sp"), X.claimed_years(folded())).alias("years"),
        S.graduation_year(folded(), Y).alias("grad"))
    return staged.select("doc_id", S.graduation_gap(F.col("years"), F.col("grad"), Y).alias("gap"))


@query("i9_latest_year", f"""SELECT o_custkey AS doc_id, coalesce(max(CASE WHEN year(o_orderdate) BETWEEN 1950 AND 1999 THEN year(o_orderdate) END), 1995) AS graduation_year
FROM orders GROUP BY o_custkey""")
def latest(spark, d):
    return ST.latest_year(order_years(spark, d), 1999)


# a customer's history, written with month names, numbers and 'present', from the order dates
_FORMS = ["MMM yyyy", "MMMM yyyy", "MM/yyyy"]
_MONTHS_SQL = """WITH o AS (SELECT o_custkey AS doc_id, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS s,
  CASE WHEN o_orderkey % 7 = 0 THEN 1999 * 12 ELSE year(o_orderdate) * 12 + month(o_orderdate) - 1 + o_orderkey % 40 END AS e FROM orders),
v AS (SELECT DISTINCT doc_id, s, e FROM o WHERE s < e AND floor(s / 12) BETWEEN 1950 AND 1999),
b AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM v),
m AS (SELECT doc_id, sum(greatest(0, e - greatest(s, coalesce(until, -1)))) AS months FROM b GROUP BY doc_id)
"""


def histories(spark, d):
    start = F.col("o_orderdate").cast("date")
    end = F.add_months(start, (F.col("o_orderkey") % 40).cast("int"))
    form = F.col("o_orderkey") % 3

    def written(day):
        return F.coalesce(*[F.when(form == k, F.date_format(day, f)) for k, f in enumerate(_FORMS)])

    line = F.concat(F.lit("Clerk, "), written(start), F.when(form == 1, " to ").otherwise(" – "),
                    F.when(F.col("o_orderkey") % 7 == 0, "Present").otherwise(written(end)))
    return I.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.concat_ws("; ", F.array_sort(F.collect_list(line))).alias("text"))


@query("i9_written_dates", _MONTHS_SQL + f"""SELECT DISTINCT o.doc_id, coalesce({D.round_exact("least(coalesce(months, 0) / 12e0, 50e0)", 1)}, 0e0) AS years
FROM o LEFT JOIN m USING (doc_id)""")
def written_dates(spark, d):
    texts = histories(spark, d).select("doc_id", X.fold(F.col("text")).alias("folded"))
    return texts.select("doc_id", S.written_years_experience(F.col("folded"), 1999).alias("years"))
